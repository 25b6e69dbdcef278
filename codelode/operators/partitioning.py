"""Directories of a repository: roll-up, choice of partitions, assignment of files, listings.

Everything that looks like a prefix join is an equi-join on exploded ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode import schemas as S
from codelode.functions import scalars as X


def dir_rollup(files: DataFrame) -> DataFrame:
    """dir, depth, file_count, total_size over each directory's whole subtree; files has relative_path and size."""
    up = files.select(F.explode(X.ancestors("relative_path")).alias("dir"), F.col("size"))
    return up.groupBy("dir").agg(F.count("*").alias("file_count"), F.sum(F.coalesce("size", F.lit(0))).alias("total_size")).withColumn("depth", X.dir_depth("dir"))


def thresholds(dirs: DataFrame, least_absolute: int = S.LEAST_FILES, ratio: float = S.LEAST_FILES_RATIO, factor: float = S.DEPTH_FACTOR, cap: int = S.MOST_DEPTH) -> DataFrame:
    """One row, min_files (a fraction of the number of files isn't cut off) and max_depth, from the average depth of all directories."""
    total = F.max(F.when(F.col("depth") == 0, F.col("file_count")))
    return dirs.agg(F.greatest(F.lit(least_absolute), total * ratio).cast("double").alias("min_files"), F.least(F.lit(cap), F.ceil(F.avg("depth") * factor)).cast("int").alias("max_depth"))


def candidates(dirs: DataFrame, min_files: int | None = None, max_depth: int | None = None, target: int = S.TARGET_FILES) -> DataFrame:
    """Directories that may become partitions, with their cost. Limits that aren't given come from thresholds()."""
    if min_files is None or max_depth is None:
        dirs = dirs.join(F.broadcast(thresholds(dirs)))  # one row
        least, deepest = F.col("min_files"), F.col("max_depth")
    else:
        least, deepest = F.lit(min_files), F.lit(max_depth)
    ok = dirs.where((F.col("depth") >= 1) & (F.col("depth") <= deepest) & (F.col("file_count") >= least))
    return ok.select("dir", "depth", "file_count", "total_size", X.partition_cost("file_count", target).alias("cost"))


def select_partitions(cands: DataFrame) -> DataFrame:
    """Candidates in the order of (cost, depth), without those under one chosen before.

    A candidate is chosen if and only if no candidate above it costs at most as much: if one does,
    then it, or what barred it, was chosen before.
    """
    below = cands.withColumn("above", F.explode(X.ancestors("dir"))).select(F.col("dir").alias("d"), F.col("cost").alias("own"), "above")
    barred = below.join(cands.select(F.col("dir").alias("above"), F.col("cost").alias("theirs")), "above").where("theirs <= own").select(F.col("d").alias("dir"))
    return cands.join(barred, "dir", "left_anti")


def assign_partitions(files: DataFrame, selected: DataFrame) -> DataFrame:
    """relative_path and dir, the deepest chosen directory that holds it, or . for none."""
    up = files.select("relative_path", F.explode(X.ancestors("relative_path")).alias("dir"))
    held = up.join(selected.select("dir", "depth"), "dir").groupBy("relative_path").agg(F.max_by("dir", "depth").alias("dir"))
    return files.select("relative_path").join(held, "relative_path", "left").select("relative_path", F.coalesce("dir", F.lit(".")).alias("dir"))


def partition_map(files: DataFrame, repo_uuid: str, **limits) -> DataFrame:
    """relative_path and partition_name for every file: roll-up, candidates, choice and assignment in one plan."""
    chosen = select_partitions(candidates(dir_rollup(files), **limits))
    return assign_partitions(files, chosen).select("relative_path", X.partition_name(F.lit(repo_uuid), "dir").alias("partition_name"))


def list_dir(files: DataFrame, prefix: str = "") -> DataFrame:
    """entry: what lies directly under a prefix; directories end in a slash."""
    p = X.listing_prefix(F.lit(prefix))
    rest = F.substring(F.col("relative_path"), F.length(p) + 1, F.lit(1 << 30))
    under = files.where(F.startswith(F.col("relative_path"), p)).select(rest.alias("rest")).where("rest <> ''")
    return under.select(F.when(F.contains(F.col("rest"), F.lit("/")), F.concat(F.substring_index("rest", "/", 1), F.lit("/"))).otherwise(F.col("rest")).alias("entry")).distinct()


def largest_first(files: DataFrame, assigned: DataFrame) -> DataFrame:
    """Files by partition, the one with most files first, and by size in it: the order in which work is handed out."""
    counts = assigned.groupBy("dir").agg(F.count("*").alias("partition_files"))
    return files.join(assigned, "relative_path").join(counts, "dir").orderBy(F.desc("partition_files"), "dir", F.desc("size"), "relative_path")
