"""Page layout: reading order, columns and merging of text blocks (page, block_id, text, x0, y0, x1, y1, …).

y grows downwards, as from a top-left origin.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import cut

#: Gap between columns, tolerance of a line, gaps that merge blocks or end a group of words.
COLUMN_GAP, LINE_TOLERANCE, LINE_SHARE, MERGE_GAP, WORD_GAP, WORD_DROP, SAME_PLACE = 50.0, 5.0, 0.3, 10.0, 20.0, 5.0, 2.0


def reading_order(blocks: DataFrame, by: list[str] = ["page"]) -> DataFrame:  # noqa: B006
    """blocks with line_no and position: lines from the top, blocks of a line from the left.

    A block begins a line where its base differs from that of the block before it (by base, then x0)
    by more than the tolerance: 5, or 0.3 of the page's mean height if that is more.
    """
    height = F.avg(F.col("y1") - F.col("y0")).over(Window.partitionBy(*by))
    w = Window.partitionBy(*by).orderBy("y1", "x0", "block_id")
    new = F.when(F.col("y1") - F.lag("y1").over(w) <= F.greatest(F.lit(LINE_TOLERANCE), F.col("_height") * LINE_SHARE), 0).otherwise(1)
    lined = blocks.withColumn("_height", height).withColumn("_new", new).withColumn("line_no", F.sum("_new").over(w))
    return lined.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("line_no", "x0", "block_id"))).drop("_height", "_new")


def columns(blocks: DataFrame, by: list[str] = ["page"], gap: float = COLUMN_GAP) -> DataFrame:  # noqa: B006
    """blocks with column_no: 0 and 1 where the largest gap between centres is over gap and leaves two blocks on each side, else 0."""
    centre = (F.col("x0") + F.col("x1")) / 2
    w = Window.partitionBy(*by).orderBy(centre, "block_id")
    g = blocks.withColumn("_c", centre).withColumn("_gap", centre - F.lag(centre).over(w)).withColumn("_n", F.row_number().over(w))
    widest = g.groupBy(*by).agg(F.max_by(F.struct("_c", "_n", "_gap"), F.struct(F.coalesce("_gap", F.lit(-1.0)), -F.col("_n"))).alias("_w"), F.count("*").alias("_all"))
    split = (F.col("_w._gap") > gap) & (F.col("_w._n") > 2) & (F.col("_all") - F.col("_w._n") + 1 >= 2)
    return g.join(widest, by).withColumn("column_no", F.when(split & (F.col("_c") >= F.col("_w._c")), 1).otherwise(0)).drop("_c", "_gap", "_n", "_w", "_all")


def word_groups(words: DataFrame, by: list[str] = ["page"]) -> DataFrame:  # noqa: B006
    """Blocks from words in the order of block_id: a new one where the gap to the word before is over 20, or the drop over 5."""
    w = Window.partitionBy(*by).orderBy("block_id")
    new = F.when((F.col("x0") - F.lag("x1").over(w) <= WORD_GAP) & (F.abs(F.col("y0") - F.lag("y0").over(w)) <= WORD_DROP), 0).otherwise(1)
    g = words.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda x: x["text"]), " ")
    return g.groupBy(*by, "group_no").agg(text.alias("text"), *bounds())


def elements(text: DataFrame, images: DataFrame, by: list[str] = ["page"]) -> DataFrame:  # noqa: B006
    """Text blocks and images of pages as one table with kind and position, from the top and then from the left."""
    both = text.withColumn("kind", F.lit("text")).unionByName(images.withColumn("kind", F.lit("image")), allowMissingColumns=True)
    return both.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("y0", "x0", "kind", "block_id")))


def bounds() -> list:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def _per_page(blocks: DataFrame, by: list[str], fn) -> DataFrame:
    return blocks.groupBy(*by).applyInPandas(lambda pdf: fn(pdf.sort_values("block_id")), blocks.schema)


def without_repeats(blocks: DataFrame, by: list[str] = ["page"]) -> DataFrame:  # noqa: B006
    """Blocks of two characters or more, without those that repeat a kept earlier one in the same place.

    What is kept depends on what was kept before, so a page is one task's work.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict[str, list[tuple[float, float]]] = {}
        rows = []
        for i, r in enumerate(pdf.itertuples()):
            t = (r.text or "").strip()
            near = kept.setdefault(t, [])
            if len(t) >= 2 and not any(abs(x - r.x0) < SAME_PLACE and abs(y - r.y0) < SAME_PLACE for x, y in near):
                near.append((r.x0, r.y0))
                rows.append(i)
        return pdf.iloc[rows]

    return _per_page(blocks, by, keep)


def merged(blocks: DataFrame, by: list[str] = ["page"], gap: float = MERGE_GAP) -> DataFrame:  # noqa: B006
    """Blocks merged with the first unmerged one that they overlap vertically within a horizontal gap; text by x0."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, used, out = pdf.to_dict("records"), set(), []
        for i, a in enumerate(rows):
            if i in used:
                continue
            group = [a]
            for j in range(i + 1, len(rows)):
                b = rows[j]
                overlap = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
                apart = max(b["x0"] - a["x1"], a["x0"] - b["x1"])
                if j not in used and overlap > 0 and apart < gap:
                    used.add(j)
                    group.append(b)
            group.sort(key=lambda r: r["x0"])
            out.append(a | {"text": " ".join(r["text"] for r in group), "x0": min(r["x0"] for r in group), "y0": min(r["y0"] for r in group), "x1": max(r["x1"] for r in group), "y1": max(r["y1"] for r in group)})
        return pd.DataFrame(out, columns=pdf.columns)

    return _per_page(blocks, by, merge)


def clusters(blocks: DataFrame, by: list[str] = ["page"], eps: float = 20.0, least: int = 2) -> DataFrame:  # noqa: B006
    """blocks with cluster: density clusters of their centres, numbered by their first block; blocks in none are clusters of their own.

    Centres lie in squares of side eps / sqrt(2), all of whose blocks are near each other; others that may be near are at most two squares
    away. A square of `least` blocks or more has only core blocks, others are counted with the squares around. Clusters are
    connected squares of core blocks. A block that isn't core belongs to the first cluster, by number, of a core
    block near it. Work grows with the blocks and their neighbours, pages may have any size, and no page is gathered in one task.
    """
    side, given, by = eps / math.sqrt(2), blocks.columns, ["_page", *by]
    blocks = blocks.withColumn("_page", F.to_json(F.struct(*by[1:])))  # one key, which isn't null where a page is
    by = by[:1]
    place = lambda c: F.floor(F.col(c) / side).cast("long")
    ids = F.row_number().over(Window.partitionBy(*by).orderBy("block_id"))
    b = cut(blocks.withColumn("_n", ids).withColumn("_x", (F.col("x0") + F.col("x1")) / 2).withColumn("_y", (F.col("y0") + F.col("y1")) / 2).withColumn("_i", place("_x")).withColumn("_j", place("_y")))
    key = [*by, "_i", "_j"]
    sizes = b.groupBy(*key).agg(F.count("*").alias("_size"))
    points = b.join(sizes, key).select(*key, "_n", "_x", "_y", "_size")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0) and abs(i) + abs(j) < 4])
    near = (F.col("_x") - F.col("_px")) ** 2 + (F.col("_y") - F.col("_py")) ** 2 <= eps**2

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """left's points beside those of right in the squares around that are near."""
        spread = left.withColumn("_o", F.explode(around)).withColumn("_i", F.col("_i") + F.col("_o.i")).withColumn("_j", F.col("_j") + F.col("_o.j"))
        other = right.select(*key, F.col("_x").alias("_px"), F.col("_y").alias("_py"), F.col("_n").alias("_pn"))
        return spread.join(other, key).where(near)

    # core blocks: squares that are full as they are; of the others those with enough blocks around
    full = points.where(F.col("_size") >= least)
    rest = points.where(F.col("_size") < least)
    counted = met(rest, points).groupBy(*by, "_n").agg(F.count("*").alias("_more"))
    rest = rest.join(counted, [*by, "_n"], "left").where(F.col("_size") + F.coalesce("_more", F.lit(0)) >= least).select(*points.columns)
    core = cut(full.unionByName(rest))
    # squares of core blocks that touch
    squares = core.groupBy(*key).agg(F.min("_n").alias("_first"))
    home = core.select(*by, "_n", F.col("_i").alias("_a"), F.col("_j").alias("_b"))
    # blocks of one place count once, so that many copies of a block don't meet
    lone = core.dropDuplicates([*key, "_x", "_y"])
    touching = met(lone, lone).select(*by, "_n", F.col("_i").alias("_c"), F.col("_j").alias("_d")).distinct().join(home, [*by, "_n"])
    name = lambda i, j: F.concat_ws(" ", *[F.col(c).cast("string") for c in by], F.col(i).cast("string"), F.col(j).cast("string"))
    edges = touching.select(name("_a", "_b").alias("a"), name("_c", "_d").alias("b")).where("a < b").distinct()
    roots = components(edges)
    named = squares.withColumn("_square", name("_i", "_j")).join(roots, F.col("_square") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_square"))
    of = cut(named.withColumn("_cluster", F.min("_first").over(Window.partitionBy(*by, "_root"))).select(*key, "_cluster"))
    inside = core.join(of, key).select(*by, "_n", "_cluster")
    # others take the first cluster near them
    loose = b.select(*points.columns[:-1]).join(inside.select(*by, "_n"), [*by, "_n"], "left_anti")
    own_square = loose.join(core.select(*key, F.col("_n").alias("_pn")), key).select(*by, "_n", "_pn")
    taken = met(loose, core).select(*by, "_n", "_pn").unionByName(own_square).join(inside.withColumnRenamed("_n", "_pn"), [*by, "_pn"]).groupBy(*by, "_n").agg(F.min("_cluster").alias("_cluster"))
    all_ = b.join(inside.unionByName(taken), [*by, "_n"], "left").withColumn("_lone", F.col("_cluster").isNull())
    # clusters first, by their first core block, then lone blocks
    head = F.struct("_lone", F.coalesce("_cluster", "_n"))
    return all_.withColumn("cluster", F.dense_rank().over(Window.partitionBy(*by).orderBy(head)) - 1).select(*given, F.col("cluster").cast("int").alias("cluster"))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node of edges (a, b), by taking over the least root of neighbours and of roots in turn."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        # the least root among neighbours, given to the root that a node has, and then each root's own root
        seen = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hooked = state.join(seen, "node").groupBy("root").agg(F.min(F.least("root", "r")).alias("to"))
        jumped = hooked.join(hooked.select(F.col("root").alias("to"), F.col("to").alias("next")), "to", "left").select("root", F.least("to", F.coalesce("next", "to")).alias("to"))
        new = cut(state.join(jumped, "root").join(seen, "node").select("node", "root", F.least("to", "r").alias("to")))
        if new.where("root <> to").isEmpty():
            return new.select("node", "root")
        state = new.select("node", F.col("to").alias("root"))


def valleys(blocks: DataFrame, by: list[str] = ["page"], low: str = "y0", high: str = "y1", width: float = 0.0, most: int | None = None) -> DataFrame:  # noqa: B006
    """band_no, first, last of each page's bands along one axis, apart where the profile is least between two peaks.

    The profile at a coordinate is how many blocks lie over it: a sweep counts 1 up where a block begins and 1 down where it ends. A
    valley is a stretch of the profile with a higher one on both sides, at least so wide and (if most is given) with no more
    blocks over it; its middle is a boundary. Along x0 and x1 with most=0 these are the columns of a page. Bands reach from
    boundary to boundary, from the least begin to the greatest end. Blocks that end before they begin, or with a null, don't count.
    """
    some = blocks.where(F.col(low) < F.col(high))
    events = some.select(*by, F.col(low).alias("at"), F.lit(1).alias("d")).unionByName(some.select(*by, F.col(high).alias("at"), F.lit(-1).alias("d")))
    w = Window.partitionBy(*by).orderBy("at")
    steps = events.groupBy(*by, "at").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("n", F.sum("d").over(w)).withColumn("until", F.lead("at").over(w))
    # the profile is a step for each change; a valley lies where it went down before and goes up after
    deep = (F.col("until") - F.col("at") >= width) & (F.lit(True) if most is None else F.col("n") <= most)
    cuts = steps.withColumn("_up", F.lead("d").over(w)).where((F.col("d") < 0) & (F.col("_up") > 0) & deep).select(*by, ((F.col("at") + F.col("until")) / 2).alias("at"))
    ends = some.groupBy(*by).agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
    begins = cuts.unionByName(ends.select(*by, F.col("_low").alias("at")))
    bands = begins.join(ends, by).withColumn("last", F.coalesce(F.lead("at").over(w), F.col("_high"))).withColumn("band_no", F.row_number().over(w) - 1)
    return bands.select(*by, "band_no", F.col("at").alias("first"), "last")


def banded(blocks: DataFrame, by: list[str] = ["page"], low: str = "y0", high: str = "y1", width: float = 0.0, most: int | None = None) -> DataFrame:  # noqa: B006
    """blocks with band_no: the band of valleys() that holds a block's middle (the one before, on a boundary); null for blocks that don't count."""
    at = (F.col(low) + F.col(high)) / 2
    # a block takes the last band that begins at or before its middle: bands and blocks in one order, no range join
    marks = valleys(blocks, by, low, high, width, most).select(*by, F.when(F.col("band_no") == 0, F.lit(float("-inf"))).otherwise(F.col("first")).alias("_at"), F.col("band_no").alias("_band"), F.lit(1).alias("_kind"))
    both = blocks.withColumn("_at", at).withColumn("_kind", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("band_no", F.max("_band").over(w)).where("_kind = 0")
    return found.select(*blocks.columns, F.when(F.col(low) < F.col(high), F.col("band_no")).alias("band_no"))
