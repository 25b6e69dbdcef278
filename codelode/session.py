"""Spark sessions with the settings that results depend on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "codelode", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Later entries of a map win over earlier ones of the same key."""
    cores = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": cores,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.appName(app).master(master or f"local[{cores}]").config(map=settings).getOrCreate()


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. A session of one machine that has none gets a
    temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codelode-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, so that plans of repeated steps stay small; it is kept in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark
