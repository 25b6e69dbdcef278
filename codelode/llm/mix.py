"""Mixing sources to target weights.

Sources share a total number of words by weight. The documents of a source are dealt by hash into
blocks; a block is drawn as a whole, once in each pass over its source. As many passes draw all blocks
as the target holds whole ones, and for what is left the last pass draws blocks in a random order, leaving
out those that no longer fit. So each source has an exact quota of blocks, whose words come near its target.

A splitting tree deals the quotas to output shards: a node that stands for some shards draws the counts
of its left half from the multivariate hypergeometric distribution of its own counts, down to single
shards. The draws of a source are permuted, and each shard takes the next of them, as many as its leaf
says; which documents are taken, how often and where follows from the blocks that the shards hold. Last,
a shard's rows are shuffled among themselves.

No task and no driver holds a source: the order of blocks is cut from a histogram of at most
BUCKETS x 64 cells, the tree's leaves are computed by ranges of shards, and blocks meet them in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import prepare, with_columns_dropped, within

WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block and of an output shard, and blocks of a small source.
BLOCK_WORDS, SHARD_WORDS, LEAST_BLOCKS = 50_000, 8_000_000, 512
#: Blocks of one pass at most, by words and by sources each; blocks grow beyond it, since the distribution is drawn below 10^9.
MOST_BLOCKS = 160_000_000
#: Parts of a source's order of blocks, and colours of the tree; of more sources, some share a colour.
BUCKETS, COLOURS = 4096, 65_536
ADDED = ("size", "source_size", "target", "taken", "copies", "shards", "drawn")


def words(text: Column) -> Column:
    """Runs without ASCII white space. Each becomes one letter, so no list of them is made."""
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(runs, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, turn (its place in order), source_size, target from source and size: a row per source.

    Sources in the order of code points, null last, weigh WEIGHTS by turns. A target stops at MOST
    times the source's size; what is above goes to the others by weight until none is above.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    s = s.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("turn") % len(WEIGHTS)).cast("int") + 1)).withColumn("most", MOST * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(upto), F.lit(0))) / F.sum("weight").over(rest))
    # sources that reach their limit come first; the first that doesn't has the level of all others
    level = F.first(F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("level")), ignorenulls=True).over(every)
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("weight") * level), F.col("most").cast("double"))
    return s.select("source", F.col("turn").cast("long").alias("turn"), "source_size", target.alias("target"))


def measured(docs: DataFrame) -> DataFrame:
    """docs with size (words) and drawn, a hash of doc_id and text; columns of docs with the added names are replaced."""
    docs = with_columns_dropped(docs, *ADDED)
    return docs.withColumn("size", words(F.col("text"))).withColumn("drawn", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))


def passes(cells: pd.DataFrame) -> pd.DataFrame:
    """The plan of one source from its cells (bucket, size_class, words, n blocks) in order: base passes that take
    every block, and the cells that the last pass takes, each where it fits into what is left of the target."""
    c = cells.sort_values(["bucket", "size_class"], kind="stable").reset_index(drop=True)
    size, target = int(c["source_size"].iloc[0]), float(c["target"].iloc[0])
    base = min(int(target // size), MOST) if size else 0
    left = target - base * size if base < MOST else 0.0
    more = np.zeros(len(c), bool)
    for i, w in enumerate(c["words"].tolist()):
        if 0 < w <= left:
            more[i], left = True, left - w
    n = c["n"].to_numpy(np.int64)
    chosen = np.where(more, n, 0)
    total = base * int(n.sum())
    c["base"], c["more"], c["draws"] = base, more, total + int(chosen.sum())
    c["of_pass"], c["first"], c["first_more"] = int(n.sum()), np.cumsum(n) - n, total + np.cumsum(chosen) - chosen
    return c[PLAN_NAMES]


PLAN = "turn long, bucket int, size_class int, base int, more boolean, draws long, of_pass long, first long, first_more long"
PLAN_NAMES = [x.split()[0] for x in PLAN.split(", ")]


def leaves(quotas: np.ndarray, shards: int, seed: int, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of shards lo to hi - 1: the shard, the colours that it has, where its draws of each begin, and how many they are.

    A node's draw depends on its own range of shards alone, so every task finds the same tree, and only
    the nodes on the way to its shards are visited.
    """
    nonzero = np.flatnonzero(quotas)
    stack = [(0, shards, nonzero, np.zeros(len(nonzero), np.int64), np.asarray(quotas, np.int64)[nonzero])]
    while stack:
        a, b, colours, begin, own = stack.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            yield a, colours, begin, own
            continue
        middle = (a + b) // 2
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, a, b])))
        left = rng.multivariate_hypergeometric(own, int(own.sum()) * (middle - a) // (b - a), method="marginals") if len(own) else own
        right = own - left
        x, y = left > 0, right > 0
        stack.append((middle, b, colours[y], (begin + left)[y], right[y]))
        stack.append((a, middle, colours[x], begin[x], left[x]))


def permutation(n: int, seed: int) -> tuple[int, int]:
    """a and c of the permutation x -> (a x + c) mod n."""
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, n])))
    a = int(rng.integers(1, n + 1))
    while math.gcd(a, n) > 1:
        a += 1
    return a, int(rng.integers(0, n))


def draw(rows: DataFrame, seed: int, block_words: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """From rows (source, size, drawn): sources (source, turn, source_size, target, blocks), and turn, block and
    shards of the blocks that are drawn, a shard per draw."""
    spark = rows.sparkSession
    t = targets(rows.groupBy("source", F.pmod("drawn", F.lit(64)).alias("part")).agg(F.sum("size").alias("size"))).checkpoint()
    n_sources, total, wanted = t.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    by = max(block_words, -(-total // MOST_BLOCKS))
    least = max(1, min(LEAST_BLOCKS, MOST_BLOCKS // max(n_sources, 1)))
    sources = t.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / by), F.lit(least)).cast("long"))

    of = in_blocks(rows.select("source", "size", "drawn"), sources, n_sources).withColumnsRenamed({"_turn": "turn", "_block": "block"})
    order = F.xxhash64(F.lit(seed), "turn", "block")
    blocks = of.groupBy("turn", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("order", order).withColumn("bucket", F.shiftrightunsigned("order", 52).cast("int")).withColumn("size_class", F.length(F.bin("words"))).checkpoint()
    cell = ["turn", "bucket", "size_class"]
    cells = blocks.groupBy(*cell).agg(F.sum("words").alias("words"), F.count("*").alias("n")).join(within(sources.select("turn", "source_size", "target"), n_sources), "turn")
    plan = cells.groupBy("turn").applyInPandas(passes, PLAN).checkpoint()

    # the draws of sources that share a colour follow one another
    colour = F.pmod("turn", F.lit(COLOURS))
    drawn = plan.groupBy("turn").agg(F.max("draws").alias("draws")).withColumn("colour", colour)
    drawn = drawn.withColumn("offset", F.sum("draws").over(Window.partitionBy("colour").orderBy("turn")) - F.col("draws"))
    quotas = np.zeros(min(COLOURS, max(n_sources, 1)), np.int64)
    for r in drawn.groupBy("colour").agg(F.sum("draws").alias("draws")).collect():  # at most COLOURS rows
        quotas[r["colour"]] = r["draws"]
    turned = [(i, int(q), *permutation(int(q), seed + i)) for i, q in enumerate(quotas) if q]
    turned = spark.createDataFrame(turned, "colour long, all long, a long, c long")  # at most COLOURS rows

    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("order", "block")) - 1
    each = blocks.withColumn("rank", rank).join(plan, cell).join(within(drawn.select("turn", "colour", "offset"), n_sources), "turn")
    each = each.where("base > 0 or more").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("base") + F.col("more").cast("int") - 1)))
    place = F.col("offset") + F.col("rank") + F.when(F.col("pass") < F.col("base"), F.col("pass") * F.col("of_pass") + F.col("first")).otherwise(F.col("first_more"))
    each = each.select("turn", "block", "colour", place.alias("place")).join(F.broadcast(turned), "colour")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    each = each.select("turn", "block", "colour", ((wide("a") * wide("place") + wide("c")) % wide("all")).cast("long").alias("place"))

    shards = max(1, math.ceil(wanted / shard_words))
    tasks = min(shards, max(1, spark.sparkContext.defaultParallelism, shards // 4096))

    def deal(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for shard, colours, begin, own in leaves(quotas, shards, seed, int(ids.min()), int(ids.max()) + 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(colours.astype(np.int64)), pa.array(begin), pa.array(own)], ["shard", "colour", "begin", "n"])

    leaf = spark.range(0, shards, 1, tasks).mapInArrow(deal, "shard int, colour long, begin long, n long")
    taken = leaf.select("shard", "colour", F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("place"))
    held = each.join(taken, ["colour", "place"]).groupBy("turn", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # at most MOST draws of a block
    return sources, held.checkpoint()


def in_blocks(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """rows (source, drawn, ...) with source_size, target, _turn and _block."""
    s = within(sources.withColumnsRenamed({"source": "_source", "turn": "_turn", "blocks": "_blocks"}), n_sources)
    met = rows.join(s, rows["source"].eqNullSafe(F.col("_source")))
    return met.withColumn("_block", F.pmod("drawn", "_blocks")).drop("_source", "_blocks")


def mix(docs: DataFrame, seed: int = 42, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs and size, source_size, target, copies, taken (copies x size), shards (one per copy), drawn.

    One row per row of docs, its other columns kept; columns of docs with the added names are
    replaced. Null texts have no words; documents without words are given as often as others of
    their block. Null sources are a source of their own, the last. Rows that repeat both doc_id and text
    are given equally often. The same input gives the same result. An empty table gives an empty one.
    Blocks are given whole, so a source misses its target by less than the smallest block, or cell of its
    order, that was not given; a source of few large documents may miss it by part of one.
    """
    prepare(docs.sparkSession)
    return mix_measured(measured(docs), seed, block_words, shard_words)


def mix_measured(rows: DataFrame, seed: int = 42, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """mix() for rows that measured() made."""
    sources, held = draw(rows, seed, block_words, shard_words)
    d = in_blocks(rows, sources, sources.count())
    h = within(held.withColumnsRenamed({"turn": "_turn", "block": "_block"}), held.count())
    d = d.join(h, ["_turn", "_block"], "left")
    d = d.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>"))).withColumn("copies", F.size("shards"))
    return d.withColumn("taken", F.col("copies") * F.col("size")).drop("_turn", "_block")


def emit(mixed_docs: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """The mix itself: each copy a row with the given columns and shard, dealt by shard, each shard in random order."""
    rows = mixed_docs.select(*columns, F.col("drawn").alias("_drawn"), F.posexplode("shards").alias("_copy", "shard"))
    return rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64("_drawn", "_copy", F.lit(seed))).select(*columns, "shard")
