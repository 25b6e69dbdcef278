"""Files of a working tree or a folder of a store, as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode import schemas as S
from codelode.functions import scalars as X
from codelode.session import cut


def scan(spark: SparkSession, root: str, repo_id: int, branch: str, supported_only: bool = True) -> DataFrame:
    """repo_id, branch, relative_path, size, last_modified, content (binary) of the files below root.

    Files with an ignored directory in their relative path are left out, and with supported_only
    those of other languages. Contents are read lazily: a plan that doesn't use them doesn't read them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*(?=/)", "")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    rows = raw.select(F.lit(repo_id).cast("long").alias("repo_id"), F.lit(branch).alias("branch"), F.substring(path, F.length(base) + 2, F.lit(1 << 30)).alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")
    rows = rows.where(~X.is_ignored("relative_path"))
    return rows.where(X.language_of("relative_path").isNotNull()) if supported_only else rows


@F.pandas_udf(T.StringType())
def decode_ignore(data: pd.Series) -> pd.Series:
    """Text of UTF-8 bytes; bytes that aren't UTF-8 are dropped."""
    return data.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def file_rows(scanned: DataFrame) -> DataFrame:
    """scanned with text content, language, line_count and blob_hash."""
    text = scanned.withColumn("content", decode_ignore("content"))
    return text.withColumn("language", X.language_of("relative_path")).withColumn("line_count", X.line_count("content")).withColumn("blob_hash", X.content_hash("content"))


def blobs(files: DataFrame) -> DataFrame:
    """repo_id, branch, blob_hash, content: each content of a branch once."""
    return files.groupBy("repo_id", "branch", "blob_hash").agg(F.first("content").alias("content"))


def json_lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of JSON-lines files; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def json_lists(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of files that each hold a JSON list; files that don't are dropped."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(paths)


def fixed_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with batch: the number of the batch of so many rows in the given order.

    Rows are sorted in parallel, by ranges, and numbered from how many rows the ranges before hold. The ranges are written
    down first, since a second planning of them would cut elsewhere. Batches of ties are of no certain order.
    """
    place = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(part.alias("_part")).count().withColumn("_before", F.coalesce(F.sum("count").over(upto), F.lit(0))).select("_part", "_before")
    numbered = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row a partition
    return numbered.withColumn("batch", F.floor((F.col("_before") + at) / size)).drop("_part", "_place", "_before")


SCHEMAS = {"files": S.FILES, "blobs": S.BLOBS, "nodes": S.NODES, "edges": S.EDGES, "chunks": S.CHUNKS}
