"""A substring index: which contents hold each sequence of three characters.

A content that holds a word holds all sequences of three characters of it, so the posting lists of these, intersected,
leave few contents to be read and searched. The index is keyed by the hash of a content: known ones are never
indexed again, and branches, copies and moved files share their entries. Posting lists name a content by four bytes of a hash of
its hash: two that share them are candidates together, and what is searched is the content, so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import scalars as X

#: Characters of a sequence; folders of the posting lists. Contents lie in a folder for each first two digits of their hash.
GRAM, BUCKETS = 3, 64
GRAMS = "gram string, ids array<int>"
#: Contents whose posting lists are made at once.
CONTENTS = 2048


def grams_of(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def short(blob_hash: str) -> Column:
    """The four bytes that name a content in posting lists."""
    return F.hash(blob_hash)


def postings(blobs: DataFrame) -> DataFrame:
    """gram and ids: of some contents (blob_hash, content) at a time those that hold a sequence, in lower case, each once; contents of less than GRAM characters have none."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, CONTENTS):
                lists: dict[str, list[int]] = {}
                part = batch.slice(i, CONTENTS)
                for id_, text in sorted(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    for g in grams_of(text):
                        lists.setdefault(g, []).append(id_)
                yield pa.RecordBatch.from_arrays([pa.array(list(lists), pa.string()), pa.array(list(lists.values()), pa.list_(pa.int32()))], ["gram", "ids"])

    return blobs.where("blob_hash is not null and content is not null").select(short("blob_hash").alias("id"), F.lower("content").alias("text")).mapInArrow(run, GRAMS)


def matches(grams: DataFrame, words: Sequence[str]) -> DataFrame:
    """id of the contents that hold all sequences of one of the words, each of at least GRAM characters, in lower case."""
    wanted = [(w, g, len(grams_of(w))) for w in sorted(set(words)) for g in sorted(grams_of(w))]
    of = grams.sparkSession.createDataFrame(wanted, "word string, gram string, n int")
    some = grams.where(F.col("gram").isin(*{g for _, g, _ in wanted})).select("gram", F.explode("ids").alias("id"))
    hits = some.join(F.broadcast(of), "gram").groupBy("id", "word").agg((F.count_distinct("gram") == F.first("n")).alias("all"))  # a row for each gram of the question
    return hits.where("all").select("id").distinct()


class TextIndex:
    """The index below a folder: grams by bucket, texts by the first digits of their hash, and which hashes are known."""

    def __init__(self, spark: SparkSession, root: str):
        # an index of the form before lay in the folder itself; it is made anew
        self.spark, self.root = spark, f"{root.rstrip('/')}/lists"

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def known(self) -> DataFrame:
        return self._read("known", "blob_hash string")

    def update(self, blobs: DataFrame) -> None:
        """Adds the contents (blob_hash, content) that aren't known. What was cut off before it was known is added again, which does no harm."""
        new = blobs.where("blob_hash is not null and content is not null").groupBy("blob_hash").agg(F.first("content").alias("content")).join(self.known(), "blob_hash", "left_anti")
        new.select("*", F.substring("blob_hash", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(f"{self.root}/texts")
        fresh = self.texts().join(self.known(), "blob_hash", "left_anti")
        listed = postings(fresh).withColumn("bucket", F.pmod(F.hash("gram"), F.lit(BUCKETS)))
        listed.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/grams")
        fresh.select("blob_hash").distinct().write.mode("append").parquet(f"{self.root}/known")

    def texts(self) -> DataFrame:
        return self._read("texts", "blob_hash string, content string, shard string")

    def candidates(self, words: Sequence[str]) -> DataFrame:
        """blob_hash of the known contents that may hold one of the words: all, if a word is too short for the index."""
        wanted = [w.strip().lower() for w in words if w.strip()]
        if any(len(w) < GRAM for w in wanted):
            return self.known().distinct()
        if not wanted:
            return self.known().limit(0)
        used = [r[0] for r in self.spark.createDataFrame([(g,) for w in wanted for g in grams_of(w)], "gram string").select(F.pmod(F.hash("gram"), F.lit(BUCKETS))).distinct().collect()]
        found = matches(self._read("grams", f"{GRAMS}, bucket int").where(F.col("bucket").isin(*used)), wanted)
        return self.known().distinct().join(found, short("blob_hash") == found["id"], "left_semi")

    def holding(self, words: Sequence[str]) -> DataFrame:
        """blob_hash of the known contents that hold one of the words, whatever their case; only folders with candidates are read."""
        found = self.candidates(words)
        shards = [r[0] for r in found.select(F.substring("blob_hash", 1, 2)).distinct().collect()]  # 256 at most
        some = self.texts().where(F.col("shard").isin(*shards)).join(found, "blob_hash", "left_semi")
        return some.where(X.contains_any("content", words)).select("blob_hash").distinct()


def fulltext(index: TextIndex, files: DataFrame, words: Sequence[str]) -> DataFrame:
    """relative_path of the text files (relative_path, blob_hash) whose content the index knows to hold any of the words."""
    return files.where(X.is_text_file("relative_path")).join(index.holding(words), "blob_hash", "left_semi").select("relative_path")
