"""Tasks: state from an event log, history, and how long they took."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def task_state(log: DataFrame) -> DataFrame:
    """The state of each task from its events (task_id, ts, seq, status, message, progress, details).

    The latest event that has a value gives it. Ended tasks are at 100 %. Details are merged, later
    ones win; messages are kept in order as log_history.
    """
    order = F.struct("ts", "seq")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    said = F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("ts", "seq", "message"))))
    s = log.groupBy("task_id").agg(latest("status"), latest("message"), latest("progress"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), said.alias("_said"))
    # the latest value of each key, aggregated before any map is made
    keys = log.select("task_id", "ts", "seq", F.explode("details").alias("key", "value")).groupBy("task_id", "key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    maps = keys.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("_details"))
    s = s.join(maps, "task_id", "left")
    merged = F.coalesce("_details", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    ended = F.col("status").isin("completed", "failed")
    return s.select(
        "task_id", "status", "message", F.when(ended, 100.0).otherwise(F.coalesce("progress", F.lit(0.0))).alias("progress"), "started_at",
        F.when(ended, F.col("updated_at")).alias("completed_at"), merged.alias("details"), F.transform("_said", lambda e: e["message"]).alias("log_history"),
    )


def merge_details(old, new):
    """Entries of both maps; those of new win."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def latest_task(tasks: DataFrame) -> DataFrame:
    """Each repository's root task that began last."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("started_at"), F.desc("task_id"))
    return tasks.where("parent_id is null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_children(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """parents with children: their tasks by when they began."""
    kids = tasks.where("parent_id is not null").groupBy(F.col("parent_id").alias("task_id")).agg(F.array_sort(F.collect_list(F.struct("started_at", F.col("task_id").alias("child_id"), "name", "status"))).alias("children"))
    return parents.join(kids, "task_id", "left")


def with_placed_children(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """What with_children gives. Children are put in order by a sort that can spill; a list is then the set of its places, equal children included."""
    order = ["started_at", "task_id", "name", "status"]
    placed = tasks.where("parent_id is not null").withColumn("_place", F.row_number().over(Window.partitionBy("parent_id").orderBy(*order)))
    listed = F.array_sort(F.collect_set(F.struct("_place", "started_at", F.col("task_id").alias("child_id"), "name", "status")))
    kids = placed.groupBy(F.col("parent_id").alias("task_id")).agg(F.transform(listed, lambda e: e.dropFields("_place")).alias("children"))
    return parents.join(kids, "task_id", "left")


def with_child_totals(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """parents with n_children and first_child, when the first of their tasks began: what with_children lists, summed up. No list is made."""
    kids = tasks.where("parent_id is not null").groupBy(F.col("parent_id").alias("task_id")).agg(F.count("*").alias("_n"), F.min("started_at").alias("_first"))
    joined = parents.join(kids, "task_id", "left")
    return joined.withColumn("n_children", F.coalesce("_n", F.lit(0))).withColumnRenamed("_first", "first_child").drop("_n")


def with_grandchildren(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """parents with children, each of which has its own, both by when they began."""
    kids = tasks.where("parent_id is not null").select("task_id", "parent_id", "name", "status", "started_at")
    grand = F.array_sort(F.collect_list(F.struct("started_at", F.col("task_id").alias("child_id"), "name", "status"))).alias("grandchildren")
    below = kids.groupBy("parent_id").agg(grand).withColumnRenamed("parent_id", "task_id")
    own = F.array_sort(F.collect_list(F.struct("started_at", F.col("task_id").alias("child_id"), "name", "status", "grandchildren"))).alias("children")
    return parents.join(kids.join(below, "task_id", "left").groupBy("parent_id").agg(own).withColumnRenamed("parent_id", "task_id"), "task_id", "left")


def details_of(state: DataFrame, task_id, key: str) -> DataFrame:
    """task_id and value: what a task's details say under a key; no row where they don't."""
    return state.where(F.col("task_id") == task_id).select("task_id", F.col("details")[key].alias("value")).where("value is not null")


def event(spark, task_id: int, status: str | None = None, message: str | None = None, progress: float | None = None, details: dict[str, str] | None = None) -> DataFrame:
    """One event of a task's log, now; seq orders events of the same time."""
    import time

    rows = spark.createDataFrame([(task_id, time.time_ns(), status, message, progress, details)], "task_id long, seq long, status string, message string, progress double, details map<string,string>")
    return rows.withColumn("ts", F.timestamp_micros(F.floor(F.col("seq") / 1000))).select(*[c.split()[0] for c in LOG.split(", ")])


LOG = "task_id long, ts timestamp, seq long, status string, message string, progress double, details map<string,string>"


def history(tasks: DataFrame, repo_id: int, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of a repository's root tasks, latest first, with children."""
    if not (0 <= offset and 1 <= limit):
        raise ValueError("offset must be 0 or more, limit 1 or more")
    page = tasks.where((F.col("repo_id") == repo_id) & F.col("parent_id").isNull()).orderBy(F.desc("started_at"), F.desc("task_id")).offset(offset).limit(limit)
    return with_children(tasks.where(F.col("repo_id") == repo_id), page).orderBy(F.desc("started_at"), F.desc("task_id"))
