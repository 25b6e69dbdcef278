"""A cleaning pipeline over documents: STAGES in order, each reading what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents; the last adds what encoding gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import bpe, mix, quality, simhash, toxicity
from codelode.llm.common import prepare, scratch, table
from codelode.llm.queries import tokenizer

#: Documents with at least this toxicity, or less than this quality, go.
TOXIC, GOOD = 0.5, 0.6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC, by a classifier fitted on this stage's labelled documents.

    A null text counts as empty; repeated rows stay or go together. Without labels of both kinds nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(model, spark)("text") < TOXIC)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least GOOD (all, where no labels are known), by a classifier fitted on this stage's documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.weights.any():
        return docs
    return docs.where(quality.score_of(model, spark)("text") >= GOOD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least doc_id.

    A null text is an empty one, and texts without words are copies of one another. Rows without a doc_id
    stay. Rows that share a doc_id are told apart by their texts; of equal rows one stays.
    """
    found = simhash.similar_groups(docs, words=5, similarity=0.8).where("doc_id is not null").checkpoint()
    stays = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("stays"))
    gone = found.join(stays, "root").where(F.struct("doc_id", "digest") != F.col("stays")).select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_text")).distinct()
    own = F.col("doc_id").cast("long"), simhash.text_digest("text")
    kept = docs.join(gone, (own[0] == F.col("_gone")) & (own[1] == F.col("_text")), "left_anti")
    again = found.groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("_again")).distinct()
    if not again.head(1):
        return kept
    # rows that repeat doc_id and text: one of each stays
    repeats = F.col("doc_id").cast("long") == F.col("_again")
    once = kept.join(again, repeats, "left_semi").withColumn("_text", own[1]).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return kept.join(again, repeats, "left_anti").unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per copy, dealt to shards and shuffled in them.

    Null sources are a source of their own, and documents without words belong to it or to their source
    like others. Columns of docs with names that the mix uses keep their values.
    """
    own = {c: f"_own_{i}" if c.lower() in (*mix.ADDED, "shard", "copy") else c for i, c in enumerate(docs.columns)}
    rows = docs.withColumnsRenamed(own)
    return mix.emit(mix.mix(rows), rows.columns).drop("shard").withColumnsRenamed({v: k for k, v in own.items()})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of tokens, and digests of its ids and of the text decoded from them; null texts are empty."""
    return bpe.round_trip(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_dedup", drop_copies), ("mix", mix_sources), ("encode", encode)]
#: Fitted models and a random mix can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
