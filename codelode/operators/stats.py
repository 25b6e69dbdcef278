"""Repository statistics, usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode import schemas as S
from codelode.functions import scalars as X


def repository_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per repository and branch: file_count, total_lines, total_tokens, schema_count, language_breakdown.

    Files are counted by path. A branch without chunks has no tokens.
    """
    key = ["repo_id", "branch"]
    once = files.groupBy(*key, "relative_path").agg(F.max("line_count").alias("lines"), F.max("language").alias("language"), F.max("partition_name").alias("part"))
    by_lang = once.groupBy(*key, "language").agg(F.count("*").alias("n"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"), F.collect_set("part").alias("parts"))
    named = (F.col("language").isNotNull()) & (F.col("language") != "")
    f = by_lang.groupBy(*key).agg(
        F.sum("n").alias("file_count"),
        F.sum("lines").alias("total_lines"),
        F.size(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("schema_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(named, F.struct("language", "n"))))).alias("language_breakdown"),
    )
    t = chunks.groupBy(*key).agg(F.sum("token_count").alias("total_tokens"))
    return f.join(t, key, "left").withColumn("total_tokens", F.coalesce("total_tokens", F.lit(0)))


def language_breakdown(files: DataFrame) -> DataFrame:
    """language, file_count, languages with most files first."""
    return files.where("language is not null and language <> ''").groupBy("language").agg(F.count("*").alias("file_count")).orderBy(F.desc("file_count"), "language")


def _usage(rows: DataFrame, *by: str) -> DataFrame:
    paid = rows.where(F.col("provider") != "local")
    return paid.groupBy(*by).agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def usage_totals(billing: DataFrame) -> DataFrame:
    """One row: calls, tokens and cost of all paid calls; zeros if there are none."""
    return _usage(billing)


def usage_by_model(billing: DataFrame) -> DataFrame:
    return _usage(billing, "model_name")


def usage_statistics(repositories: DataFrame, files: DataFrame, billing: DataFrame) -> DataFrame:
    """One row: repositories, files and lines analysed, and the usage totals."""
    r = repositories.agg(F.count("*").alias("total_repositories"))
    f = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    return r.join(f).join(usage_totals(billing))  # one row each


def embedding_cost(chunks: DataFrame, price: float = S.EMBEDDING_PRICE_PER_MILLION) -> DataFrame:
    return chunks.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")).withColumn("cost", F.col("tokens") / 1e6 * price)


def llm_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call's cost by its model's prices; 0 for models without a price."""
    p = prices.select("model_name", "input_per_million", "output_per_million")
    cost = X.llm_cost("prompt_tokens", "completion_tokens", F.coalesce("input_per_million", F.lit(0.0)), F.coalesce("output_per_million", F.lit(0.0)))
    return calls.join(p, "model_name", "left").withColumn("cost", cost)


def dominant(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least one on a tie."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("dominant"), F.max("_n").alias("n"))


def font_summary(blocks: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: the most frequent font, color and flags, and the mean size; Arial, 12, 0 and 0 where nothing is known."""
    out = blocks.groupBy(*by).agg(F.avg("size").alias("size"))
    for c in ("font", "color", "flags"):
        out = out.join(dominant(blocks, by, c).select(*by, F.col("dominant").alias(c)), by, "left")
    return out.select(*by, F.coalesce("font", F.lit("Arial")).alias("font"), F.coalesce("size", F.lit(12.0)).alias("size"), F.coalesce("color", F.lit(0)).alias("color"), F.coalesce("flags", F.lit(0)).alias("flags"))


def throughput(marks: DataFrame, by: list[str]) -> DataFrame:
    """For each mark (ts, total so far): the rate since the mark before, and since the first.

    Marks of one time follow by their total; the rate of such a step is infinite, or NaN where nothing was added.
    Marks without a time come last and have no rates.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("ts"), "total")
    s = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    now, before, first = s(F.col("ts")), s(F.lag("ts").over(w)), s(F.first("ts").over(w))
    added, took = (F.col("total") - F.lag("total").over(w)).cast("double"), now - before
    start = F.first("total").over(w)
    return marks.withColumn("interval_rate", F.when(took == 0, added * float("inf")).otherwise(added / F.nullif(took, F.lit(0.0)))).withColumn("mean_rate", F.when(now > first, (F.col("total") - start) / (now - first)))
