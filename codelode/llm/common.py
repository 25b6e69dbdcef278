"""What the operators of this subpackage share: tables, shared scratch space, worker set-up."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Let executors import this package and make sure that checkpoint() has a folder.

    The folder is the cluster's own (spark.checkpoint.dir). A session of one machine that has none gets a
    temporary one; on a cluster that is an error, since executors elsewhere couldn't read it.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    # texts are long: smaller batches than the default of 64 MB keep workers small
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) == 64 << 20:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    if folder := spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="codelode-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that may be broadcast, some megabytes of memory.
MOST_BROADCAST = 100_000


def within(df: DataFrame, n: int) -> DataFrame:
    """df, whose n rows are narrow, to be broadcast if they are few; beyond that the optimizer chooses the join and splits hot keys."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def splittable(df: DataFrame, *keys: str) -> DataFrame:
    """df, which an aggregate by keys (whole numbers, strings or bytes) made, as a side of a join by them.

    Spark splits the partition of a hot key only where both sides are dealt for the join. What an aggregate made
    is dealt by its keys already and would be joined as it lies; the keys are written anew, with equal values, so
    that it is dealt once more.
    """
    kinds = dict(df.dtypes)
    anew = {k: F.substring(k, 1, (1 << 31) - 1) if kinds[k] in ("binary", "string") else F.bitwise_not(F.bitwise_not(k)) for k in keys}
    return df.withColumns(anew)


def with_columns_dropped(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with those an operator adds."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def as_text(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and text only; null texts are empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))

