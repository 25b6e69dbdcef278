"""Token counts through a cache of digests.

A row's key is the SHA-256 of its normalised content beside the SHA-256 of the tokenizer file. Keys
are joined to stored counts; of the rest each distinct content is encoded once, and its count is
appended to the cache. Texts are shuffled only for misses, one per digest and map task.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.common import as_text, prepare, splittable
from codelode.llm.pieces import Splitter, blocks, worker_table

CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text, drops_white_space: bool):
    """What the digest is made of. Outer ASCII white space goes if the tokenizer drops white space anyway."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b")) if drops_white_space else text


def stored(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache's rows; none where it doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE).parquet(cache_path)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of docs.

    Null texts are empty; empty texts have no tokens. Repeated rows and copies are each counted once
    and get a row each. Other columns are ignored. An empty table gives an empty result. A cache that
    holds a digest twice (two writers at once) does no harm: both rows say the same.
    """
    spark = prepare(docs.sparkSession)
    version = tokenizer_version(path)
    with open(path, encoding="utf-8") as f:
        drops_white_space = Splitter(json.load(f)).drops_white
    keyed = as_text(docs).withColumn("digest", F.unhex(F.sha2(normalised(F.col("text"), drops_white_space), 256)))
    known = stored(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    misses = keyed.select("digest", "text").join(known, "digest", "left_anti") if known.head(1) else keyed.select("digest", "text")
    distinct = misses.groupBy("digest").agg(F.first("text").alias("text"))

    def run(batches):
        table = worker_table(path, "library")
        for part, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts)), part.column(0), pa.array(table.counts(texts))], ["tokenizer", "digest", "n_tokens"])

    distinct.mapInArrow(run, CACHE).write.mode("append").parquet(cache_path)
    counts = stored(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return (
        keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
        .join(splittable(counts, "digest"), "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
