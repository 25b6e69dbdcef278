"""Tables on disk: one Parquet folder per entity, partitioned by repo_id and branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["repo_id", "branch"]


class Store:
    """Entities below a root folder. Each write replaces whole (repo_id, branch) partitions, so it can be repeated."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, entity: str) -> str:
        return f"{self.root}/{entity}"

    def exists(self, entity: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(entity))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def create(self, entity: str, schema: str) -> None:
        """An empty table, if there is none yet."""
        if not self.exists(entity):
            self.spark.createDataFrame([], schema).write.partitionBy(*KEY).parquet(self.path(entity))

    def read(self, entity: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self.path(entity))

    def replace(self, entity: str, rows: DataFrame, repo_id: int | None = None, branch: str | None = None) -> None:
        """Replaces the partitions that rows have; others stay. The named branch's is emptied where rows have none of it."""
        if repo_id is not None and rows.where((F.col("repo_id") == repo_id) & (F.col("branch") == branch)).isEmpty():
            self.drop(entity, repo_id, branch)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(self.path(entity))

    def drop(self, entity: str, repo_id: int, branch: str | None = None) -> None:
        """Drops a repository's partitions, or one branch's."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(entity)}/repo_id={repo_id}" + (f"/branch={branch}" if branch else ""))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def staged(self) -> Stage:
        """A place for what an ingest makes before any entity is replaced; as a context, it is gone at its end."""
        import uuid

        return Stage(self.spark, f"{self.root}/_staged/{uuid.uuid4().hex}")

    def append(self, entity: str, rows: DataFrame) -> None:
        """Adds rows of a table that isn't partitioned, such as logs."""
        rows.write.mode("append").parquet(self.path(entity))

    def size(self) -> int:
        """Bytes of all entities' files."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class Stage:
    """Tables below a folder that goes when the context ends."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written down: what is read later depends neither on their plan nor on the tables that it reads."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows to append: of each new key the first by order."""
    from pyspark.sql import Window

    new = rows.join(target.select(*key), key, "left_anti")
    return new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(target: DataFrame, rows: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """target with rows merged in by key: listed columns are updated, the others of a known row stay, new rows are added."""
    t, r = target.alias("t"), rows.alias("r")
    on = None
    for k in key:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = c if on is None else on & c
    joined = t.withColumn("_t", F.lit(1)).alias("t").join(r.withColumn("_r", F.lit(1)).alias("r"), on, "full_outer")
    pick = lambda c: (F.when(F.col("r._r") == 1, F.col(f"r.{c}")).otherwise(F.col(f"t.{c}")) if c in update or c in key else F.when(F.col("t._t") == 1, F.col(f"t.{c}")).otherwise(F.col(f"r.{c}"))).alias(c)
    return joined.select(*[pick(c) for c in target.columns])


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose content differs from what is known: what an incremental ingest has to parse."""
    return files.join(known.select("repo_id", "branch", "relative_path", "blob_hash"), ["repo_id", "branch", "relative_path", "blob_hash"], "left_anti")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by order."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
