"""A Merkle manifest of a table: leaves by group, subroots, one root, and a proof for every row.

A row's leaf is the SHA-256 of its fields. A group's leaves stand in the order of an id, and while several
nodes remain each run of `fanout` consecutive ones becomes its hash; the groups' roots, in the order of the
groups, become the root in the same way.

Ranks come from histograms of the id's digits, not from a sort of the table: rows are counted by group and
all but the last digit of the id, counts are summed up digit by digit, and what stands before a cell
follows from the digits above it. A rank written with the fanout as base is the leaf's key in a trie whose
inner nodes are prefixes of keys; the longest prefixes are reduced first, several digits at a time, so that a
task holds one bounded piece of a tree, however large the group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import prepare, splittable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a digit of an id; rows that a task ranks at most, and nodes of a piece of a tree at most.
DIGIT, MOST_RANKED, MOST_NODES = 12, 1 << 16, 4096


def leaf_of(df: DataFrame, fields: Iterable[str] = FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """The leaf of a row: SHA-256 of, for each field, `-` if it is null, else the bytes of its text, `:`, its text.

    changed names fields whose value is another than the table's.
    """

    def one(name: str) -> Column:
        text = (changed or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[one(f) for f in fields]).cast("binary"), 256))


def counted_before(cells: DataFrame, group: str, key: str) -> DataFrame:
    """cells (group, key long, n) with at, the sum of n over the group's cells of lesser keys.

    Counts are summed up by ever shorter prefixes of the key; then, from the first digit on, a cell's
    place is its parent's plus the counts of the lesser digits beside it, 2^DIGIT at most.
    """
    low, high = cells.agg(F.min(key), F.max(key)).first()
    if low is None:
        return cells.withColumn("at", F.col("n"))
    deep = max(1, -(-(high - low).bit_length() // DIGIT))
    tables = [cells.withColumn("_0", F.col(key) - low)]
    for d in range(1, deep):
        up = F.shiftright(f"_{d - 1}", DIGIT).alias(f"_{d}")
        tables.append(tables[-1].groupBy(group, up).agg(F.sum("n").alias("n")))
    above = None
    for d in reversed(range(deep)):
        here = tables[d].withColumn(f"_{d + 1}", F.shiftright(f"_{d}", DIGIT))
        beside = Window.partitionBy(group, f"_{d + 1}").orderBy(f"_{d}")
        here = here.withColumn("at", F.sum("n").over(beside) - F.col("n"))
        if above is not None:
            here = here.join(above, [group, f"_{d + 1}"]).withColumn("at", F.col("at") + F.col("_above"))
        above = here.select(group, f"_{d}", F.col("at").alias("_above"))
    return here.drop("_0", "_1", "_above")


def refined(rows: DataFrame, cell: list[str], digits: Iterable[Column], most: int) -> DataFrame:
    """rows of cells (named by `at` and the other columns of cell), each with the at of a cell of at most `most` rows.

    Cells with more rows are parted by the next digit, until all are small or there are no digits left.
    """
    small = []
    for digit in digits:
        rows = rows.withColumn("_digit", digit)
        cells = rows.groupBy(*cell, "_digit").agg(F.count("*").alias("_n"))
        beside = Window.partitionBy(*cell).orderBy("_digit")
        cells = cells.withColumn("_at", F.col("at") + F.sum("_n").over(beside) - F.col("_n"))
        rows = rows.join(splittable(cells, *cell, "_digit"), [*cell, "_digit"]).withColumn("at", F.col("_at")).drop("_digit", "_at").checkpoint()
        small.append(rows.where(F.col("_n") <= most).drop("_n"))
        rows = rows.where(F.col("_n") > most).drop("_n")
        if not rows.head(1):
            break
    else:
        small.append(rows)
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    return out


def ranked(rows: DataFrame, most: int = MOST_RANKED) -> DataFrame:
    """rows (group_key string, doc_id long, leaf binary, row long) with rank, from 0 in each group, by doc_id, leaf and row; nulls first.

    A cell is a group's ids that are alike but for the last digit. Cells of over `most` rows, which ids
    that repeat make, are parted by that digit, the leaf, and the row's place in the table.
    """
    rows = rows.withColumn("_p", F.coalesce(F.shiftright("doc_id", DIGIT), F.lit(-(1 << (63 - DIGIT)) - 1)))
    cells = counted_before(rows.groupBy("group_key", "_p").agg(F.count("*").alias("n")), "group_key", "_p").checkpoint()
    rows = rows.join(splittable(cells, "group_key", "_p"), ["group_key", "_p"]).drop("_p")
    if cells.where(F.col("n") > most).head(1):
        # a column of hex digits orders as its bytes do
        leaf = F.hex("leaf")
        digits = [F.coalesce(F.col("doc_id").bitwiseAND((1 << DIGIT) - 1), F.lit(-1)), F.substring(leaf, 1, 3), F.substring(leaf, 4, 3), F.substring(leaf, 7, 3), leaf, F.shiftright("row", 33), F.shiftright(F.col("row").bitwiseAND((1 << 33) - 1), DIGIT)]
        parted = refined(rows.where(F.col("n") > most).drop("n"), ["group_key", "at"], digits, most)
        rows = rows.where(F.col("n") <= most).drop("n").unionByName(parted)
    within = Window.partitionBy("group_key", "at").orderBy(F.asc_nulls_first("doc_id"), "leaf", "row")
    return rows.withColumn("rank", F.col("at") + F.row_number().over(within) - 1).drop("at", "n")


def ranked_texts(texts: DataFrame, name: str, most: int = MOST_RANKED) -> DataFrame:
    """A table of one row per text with the text's rank by its bytes, from 0; digits are three bytes."""
    n, longest = texts.agg(F.count("*"), F.max(F.octet_length(name))).first()
    rows = texts.withColumn("at", F.lit(0).cast("long"))
    if n > most:
        raw = F.col(name).cast("binary")
        rows = refined(rows, ["at"], (F.hex(F.substring(raw, i + 1, 3)) for i in range(0, longest, 3)), most)
    return rows.withColumn("rank", F.col("at") + F.row_number().over(Window.partitionBy("at").orderBy(name)) - 1).drop("at")


# --- the trie -------------------------------------------------------------------------------------


def joined(nodes: list[str]) -> str:
    """The hash of a run of nodes, all lowercase hex."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def depth_of(n: int, fanout: int) -> int:
    """How often n nodes have to be reduced until one remains."""
    d, room = 0, 1
    while room < n:
        d, room = d + 1, room * fanout
    return d


def digits_of(fanout: int, most: int = MOST_NODES) -> int:
    """Digits of a key that are reduced at a time: what gives at most `most` nodes, one at least."""
    d = 1
    while fanout ** (d + 1) <= most:
        d += 1
    return d


def levels(nodes: list[str], fanout: int, depth: int) -> list[list[str]]:
    """nodes, and what remains after each of depth reductions."""
    out = [nodes]
    for _ in range(depth):
        last = out[-1]
        out.append([joined(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def depth_here(place: int, n: int, fanout: int, digits: int) -> int:
    """Levels of a piece: all its digits, or what its nodes need if it is the whole tree (only then can the first piece have fewer)."""
    return depth_of(n, fanout) if place == 0 and n < fanout**digits else digits


def beside(tree: list[list[str]], fanout: int) -> list[list[tuple[str, str]]]:
    """For each node of each level but the last, its run's nodes to the left and to the right, as text."""
    return [[("".join(level[i - i % fanout : i]), "".join(level[i + 1 : i - i % fanout + fanout])) for i in range(len(level))] for level in tree[:-1]]


def path_of(sides: list[list[tuple[str, str]]], i: int, fanout: int) -> list[tuple[str, str]]:
    """The siblings of node i, level by level."""
    out = []
    for level in sides:
        out.append(level[i])
        i //= fanout
    return out


def as_path(steps: list[tuple[str, str]], rest: str) -> str:
    """Steps as text, left and right apart by `;`, each ended by `,`, before those of the levels above."""
    return "".join(f"{a};{b}," for a, b in steps) + rest


def folded(node: str, path: str) -> str:
    """The root that a node and its path give."""
    for step in path.split(",")[:-1]:
        left, right = step.split(";")
        node = joined([left, node, right])
    return node


def siblings(path: str) -> str:
    """All nodes of a path, in order."""
    return path.replace(";", "").replace(",", "")


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """The rows of each (group_key, piece), which stand together and are in order, as a table."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, place = batch.column("group_key"), batch.column("piece").to_numpy()
        code = groups.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (place[1:] != place[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = (groups[a].as_py(), int(place[a]))
            if now != key and held:
                yield *key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield *key, pa.Table.from_batches(held)


NODES = "group_key string, place long, node string"
PATHS = "group_key string, place long, path string"


def by_piece(df: DataFrame, width: int) -> DataFrame:
    """df (group_key, place, ...) with its pieces of a width of places together and in order."""
    piece, order = F.expr(f"place div {width}"), []
    if "whole_piece" in df.columns:  # the row that holds a piece's path comes first
        piece, order = F.when(F.col("whole_piece"), F.col("place")).otherwise(piece), [F.desc("whole_piece")]
    return df.withColumn("piece", piece).repartition("group_key", "piece").sortWithinPartitions("group_key", "piece", *order, "place")


def risen(nodes: DataFrame, fanout: int, digits: int) -> DataFrame:
    """The nodes (group_key, place, node) that pieces of nodes are reduced to."""

    def run(batches):
        for group, place, rows in pieces(batches):
            given = rows.column("node").to_pylist()
            top = levels(given, fanout, depth_here(place, len(given), fanout, digits))[-1]
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([place]), pa.array([top[0]])], ["group_key", "place", "node"])

    return by_piece(nodes.select("group_key", "place", "node"), fanout**digits).mapInArrow(run, NODES)


def tower(nodes: DataFrame, fanout: int, digits: int) -> list[DataFrame]:
    """nodes and what they are reduced to, up to one node a group."""
    out = [nodes]
    while out[-1].where("place > 0").head(1):
        out.append(risen(out[-1], fanout, digits).checkpoint())
    return out


def with_paths(nodes: DataFrame, above: DataFrame, fanout: int, digits: int) -> DataFrame:
    """nodes (group_key, place, node, ...) beside above (group_key, place, path), which has a row for each piece: in order, for a pass over pieces."""
    own = nodes.withColumn("whole_piece", F.lit(False)).withColumn("path", F.lit(None).cast("string"))
    of = above.select("group_key", "place", "path", F.lit(True).alias("whole_piece"))
    return by_piece(own.unionByName(of, allowMissingColumns=True), fanout**digits)


def descended(nodes: DataFrame, above: DataFrame, fanout: int, digits: int) -> DataFrame:
    """The path (group_key, place, path) of each node."""

    def run(batches):
        for group, place, rows in pieces(batches):
            rest, given = rows.column("path")[0].as_py(), rows.column("node").to_pylist()[1:]
            sides = beside(levels(given, fanout, depth_here(place, len(given), fanout, digits)), fanout)
            own = [as_path(path_of(sides, i, fanout), rest) for i in range(len(given))]
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(given), pa.string()), rows.column("place").combine_chunks()[1:].cast(pa.int64()), pa.array(own, pa.string())], ["group_key", "place", "path"])

    return with_paths(nodes.select("group_key", "place", "node"), above, fanout, digits).mapInArrow(run, PATHS)


# --- the operator ---------------------------------------------------------------------------------

PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, proof string, folded_root string, verified boolean"


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: Iterable[str] = FIELDS, group: str = "source", fanout: int = 3, with_proof: bool = True, most: int = MOST_RANKED, digits: int | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, proof, folded_root and verified of every row of docs.

    proof has the siblings on the way from the leaf by the subroot to the root, level by level, left and right apart
    by `;`, levels ended by `,` (null unless with_proof); proof_sha256 is the hash of the siblings alone.
    changed gives values that fields have now; folded_root is what the leaf made of them and the stored siblings give,
    verified whether that is the root. Rows of a group stand by doc_id, nulls first, then by leaf; the groups by the bytes
    of their name, null first. Equal rows have a leaf and a proof each. Null fields differ from empty ones. Columns that
    aren't fields are ignored. A lone row's subroot is its leaf, and a lone group's subroot is the root. An
    empty table gives no rows.
    """
    fields = list(fields)
    prepare(docs.sparkSession)
    digits = digits or digits_of(fanout)
    # '' for null and a sign before all else, so that null comes first and differs from ''
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(key.alias("group_key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(docs, fields).alias("leaf"), leaf_of(docs, fields, changed).alias("now"), F.monotonically_increasing_id().alias("row")).checkpoint()
    placed = ranked(rows, most).select("group_key", F.col("rank").alias("place"), "doc_id", F.lower(F.hex("leaf")).alias("node"), F.when(F.col("now") != F.col("leaf"), F.lower(F.hex("now"))).alias("now")).checkpoint()

    trees = tower(placed, fanout, digits)
    subroots = trees[-1].select("group_key", "node") if len(trees) > 1 else trees[0].select("group_key", "node").checkpoint()
    of_group = ranked_texts(subroots, "group_key", most).select(F.lit("").alias("group_key"), F.col("rank").alias("place"), "node", F.col("group_key").alias("of")).checkpoint()
    roots = tower(of_group.select("group_key", "place", "node"), fanout, digits)
    root = roots[-1].head()
    if root is None:
        return docs.sparkSession.createDataFrame([], PROOFS)
    root = root["node"]

    paths = roots[-1].select("group_key", "place", F.lit("").alias("path"))
    for nodes in reversed(roots[:-1]):
        paths = descended(nodes, paths, fanout, digits).checkpoint()
    # of a group: what leads from its subroot to the root
    above = of_group.select("place", "of", "node").join(paths.select("place", "path"), "place").select(F.col("of").alias("group_key"), F.lit(0).cast("long").alias("place"), F.concat("node", F.lit("|"), "path").alias("path"))
    for nodes in reversed(trees[1:-1]):
        above = descended(nodes, above, fanout, digits).checkpoint()

    def run(batches):
        for _, place, rows in pieces(batches):
            rest, given = rows.column("path")[0].as_py(), rows.column("node").to_pylist()[1:]
            ids, now = rows.column("doc_id").combine_chunks()[1:], rows.column("now").to_pylist()[1:]
            # lower levels of the group stand before its subroot's name in the text
            lower, _, upper = rest.rpartition("|")
            lower, subroot = lower[:-64], lower[-64:]
            rest = lower + upper
            sides = beside(levels(given, fanout, depth_here(place, len(given), fanout, digits)), fanout)
            proof = [as_path(path_of(sides, i, fanout), rest) for i in range(len(given))]
            digest = [hashlib.sha256(siblings(p).encode()).hexdigest() for p in proof]
            got = [folded(n or x, p) for x, n, p in zip(given, now, proof, strict=True)]
            k = len(given)
            columns = [ids, pa.array(given), pa.array([subroot] * k), pa.array([root] * k), pa.array(digest), pa.array(proof if with_proof else [None] * k, pa.string()), pa.array(got), pa.array([x == root for x in got])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PROOFS.split(", ")])

    return with_paths(placed, above, fanout, digits).mapInArrow(run, PROOFS)
