"""Near-duplicate documents by SimHash, compared exactly tile by tile.

A fingerprint's bit is set where over half of a text's shingles have it set in their hash. Distinct
fingerprints lie in cells such that any two that may link share a cell or lie in neighbouring ones:

* within a radius of r of 64 bits, of r + k blocks of bits at least k are equal, so a cell is a choice
  of k blocks and their bits, and no link is lost; k grows with the number of prints, so that cells don't;
* for a similarity of shingle sets, a cell is a band of least values of the set under random hashes, which
  sets share with the odds of their similarity each; with BANDS bands of BAND_ROWS the odds that a pair at 0.8
  shares none are under 2e-5. What prints link here are candidates, and the sets of each group of
  candidates are compared exactly.

Within cells, fingerprints in the order of their population count form tiles. Tiles are compared by
numpy's exclusive-or and bit count; pairs of tiles whose population counts differ beyond the radius
are skipped. Of the links that a comparison finds only a spanning forest leaves the task, so a group
of copies makes as many rows as it has fingerprints, not as it has pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import as_text, prepare
from codelode.llm.components import components
from codelode.llm.pieces import blocks

#: Fingerprints of a tile, tiles of a group, rows of a sub-tile, and runs that are compared by shifts.
TILE, GROUP, ROWS, SHORT = 4096, 8, 256, 24
#: Widest radius of 64-bit prints, and how many prints a cell may hold by chance.
WIDEST, CELL_PRINTS = 4, 16
SEED = 42
TILES = "cell long, part int, seq int, low int, high int, nodes binary, prints binary, a array<long>, b array<long>"


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the shingles, repeats included. Words are runs without ASCII white space, A-Z in lower case."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    ends = list(itertools.accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    k = min(words, len(w))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64)


def majority(h: np.ndarray, bits: int) -> np.ndarray:
    """bits / 64 words whose bits are set in over half of the hashes. Words after the first scatter the hash anew."""
    n = bits // 64
    out = np.zeros(bits, np.int64)
    for i in range(0, len(h), 255):  # so many bits of a place fit a byte
        part = h[i : i + 255]
        wide = np.empty((len(part), n), np.uint64)
        wide[:, 0] = part
        for j in range(1, n):
            x = part + np.uint64((0x9E3779B97F4A7C15 * j) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, j] = x ^ (x >> np.uint64(31))
        out += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * out > len(h), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, repeats: bool = True) -> DataFrame:
    """doc_id, print (bits as little-endian binary), n (shingles, or distinct ones without repeats).

    Texts of fewer words have one shingle, the whole sequence; texts without words, empty and null
    ones have the print zero and n 0. One row per row of docs; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for part, texts in blocks(batches):
            prints, n = [], []
            for t in texts:
                h = shingle_hashes(t, words)
                h = h if repeats else np.unique(h)
                n.append(len(h))
                prints.append(majority(h, bits).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "print", "n"])

    return as_text(docs).mapInArrow(run, "doc_id long, print binary, n long")


def counts(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints).sum(1, dtype=np.int64)


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of a lie within the radius of which rows of b."""
    if a.shape[1] == 1:
        return np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) <= radius
    differ = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
    for k in range(1, a.shape[1]):
        differ += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return differ <= radius


def forest(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what lies within the radius across two tiles, or within one if they are the same.

    Rows are in the order of their population counts.
    """
    pa_, pb = counts(a), counts(b)
    if len(a) and len(b) and (pa_[0] - pb[-1] > radius or pb[0] - pa_[-1] > radius):
        return
    nodes, inverse = np.unique(np.concatenate([na, nb]), return_inverse=True)
    ia, ib = inverse[: len(na)], inverse[len(na) :]
    label = np.arange(len(nodes))
    for i in range(0, len(a), ROWS):
        part = slice(i, i + ROWS)
        lo = np.searchsorted(pb, pa_[part][0] - radius, side="left")
        hi = np.searchsorted(pb, pa_[part][-1] + radius, side="right")
        if lo == hi:
            continue
        hit = near(a[part], b[lo:hi], radius)
        for r in np.flatnonzero(hit.any(1)):
            x = ia[i + r]
            others = ib[lo:hi][hit[r]]
            others = others[label[others] != label[x]]
            if len(others):
                found, at = np.unique(label[others], return_index=True)
                for y in others[at]:
                    yield int(nodes[x]), int(nodes[y])
                label[np.isin(label, found)] = label[x]


class _Out:
    """Rows of TILES: links by the thousand, and tiles."""

    def __init__(self):
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, pairs) -> None:
        for x, y in pairs:
            self.a.append(x)
            self.b.append(y)

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if len(self.a) >= 4096 or last and self.a:
            yield _row(None, None, None, None, None, None, None, self.a, self.b)
            self.a, self.b = [], []


_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], [x.split()[0] for x in TILES.split(", ")])


def _tile(cell: int, part: int, seq: int, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    pc = counts(prints)
    return _row(cell, part, seq, int(pc[0]), int(pc[-1]), nodes.astype("<i8").tobytes(), prints.astype("<u8").tobytes(), None, None)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have the same width, as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)


def cells_searched(rows: DataFrame, radius: int, width: int, direct: bool) -> DataFrame:
    """Rows of TILES from rows (cell, pc, node, print) that are sorted by cell and pc within partitions.

    A cell of at most TILE rows is searched at once and leaves its links; a larger one leaves its
    tiles. If not direct, every cell leaves its tiles.
    """

    def run(batches):
        part, out, seq = TaskContext.get().partitionId(), _Out(), 0
        cell = np.zeros(0, np.int64)
        node = np.zeros(0, np.int64)
        prints = np.zeros((0, width), np.uint64)
        hot = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cell = np.concatenate([cell, np.asarray(batch.column(0))])
                node = np.concatenate([node, np.asarray(batch.column(1))])
                prints = np.concatenate([prints, _fixed(batch.column(2), width)])
            if not len(cell):
                continue
            cuts = np.flatnonzero(np.diff(cell)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cell)]])
            done = ends[-1] if batch is None else starts[-1]  # the last cell may go on
            if direct:
                pc = counts(prints)
                short = (ends - starts <= SHORT) & (ends <= done) & (cell[starts] != hot if hot is not None else True)
                size = np.repeat(np.where(short, ends - starts, 0), ends - starts)
                for d in range(1, int(size.max(initial=0))):
                    at = np.flatnonzero((size[:-d] > d) & (cell[:-d] == cell[d:]) & (pc[d:] - pc[:-d] <= radius))
                    at = at[np.bitwise_count(prints[at] ^ prints[at + d]).sum(1, dtype=np.int64) <= radius]
                    out.add(zip(node[at].tolist(), node[at + d].tolist(), strict=True))
                yield from out.rows()
            else:
                short = np.zeros(len(starts), bool)
            for s, e in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True):
                whole = e <= done
                if whole and direct and e - s <= TILE and cell[s] != hot:
                    if e - s > 1:
                        out.add(forest(node[s:e], prints[s:e], node[s:e], prints[s:e], radius))
                        yield from out.rows()
                    continue
                while e - s > TILE or whole and s < e:
                    if not (direct and cell[s] != hot and e - s <= TILE):
                        hot = cell[s]
                        top = min(e, s + TILE)
                        yield _tile(int(cell[s]), part, seq, node[s:top], prints[s:top])
                        seq, s = seq + 1, top
                if not whole:
                    done = s
            cell, node, prints = cell[done:], node[done:], prints[done:]
        yield from out.rows(last=True)

    return rows.select("cell", "node", "print").mapInArrow(run, TILES)


def links(rows: DataFrame, radius: int, bits: int, direct: bool = True) -> DataFrame:
    """a, b: links that connect all rows (cell, pc, node, print) within the radius that share a cell."""
    width = bits // 64
    if direct:
        dealt = rows.repartition("cell").sortWithinPartitions("cell", "pc", "node")
    else:  # few large cells: ranges of population counts spread them over tasks
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(tasks, "cell", "pc", "node").sortWithinPartitions("cell", "pc", "node")
    first = cells_searched(dealt, radius, width, direct).checkpoint()
    found = first.where("a is not null").select(F.inline(F.arrays_zip("a", "b")))
    tiles = first.where("a is null").select("cell", "part", "seq", "low", "high", "nodes", "prints", F.expr(f"seq div {GROUP}").cast("int").alias("grp"))
    # a row per group of tiles: its range of population counts
    groups = tiles.groupBy("cell", "part", "grp").agg(F.min("low").alias("g_low"), F.max("high").alias("g_high")).select(F.col("cell").alias("g_cell"), F.col("part").alias("g_part"), F.col("grp").alias("g_grp"), "g_low", "g_high")
    reach = groups.withColumn("cell", F.col("g_cell"))
    earlier = F.struct("g_part", "g_grp") <= F.struct("part", "grp")
    meets = tiles.join(reach, "cell").where(earlier & (F.col("low") - F.col("g_high") <= radius) & (F.col("g_low") - F.col("high") <= radius))
    guests = meets.select("g_cell", "g_part", "g_grp", F.lit(1).alias("kind"), "cell", "part", "seq", "nodes", "prints")
    own = tiles.select(F.col("cell").alias("g_cell"), F.col("part").alias("g_part"), F.col("grp").alias("g_grp"), F.lit(0).alias("kind"), "cell", "part", "seq", "nodes", "prints")

    def compare(batches):
        now, held, out = None, [], _Out()
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["g_cell"], r["g_part"], r["g_grp"])
                if key != now:
                    now, held = key, []
                place = (r["cell"], r["part"], r["seq"])
                tile = np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["prints"], "<u8").reshape(-1, width)
                if r["kind"] == 0:
                    held.append((place, *tile))
                    continue
                for mine, nodes, prints in held:
                    if mine <= place:
                        out.add(forest(nodes, prints, *tile, radius))
                for b in out.rows():
                    yield b.select(["a", "b"])
        for b in out.rows(last=True):
            yield b.select(["a", "b"])

    keys = ["g_cell", "g_part", "g_grp"]
    dealt = own.union(guests).repartition(*keys).sortWithinPartitions(*keys, "kind", "cell", "part", "seq")
    more = dealt.mapInArrow(compare, "a array<long>, b array<long>").select(F.inline(F.arrays_zip("a", "b")))
    return found.union(more)


def blocks_for(n: int, radius: int) -> int:
    """How many blocks of n distinct prints must be equal, so that a cell has a few prints by chance: cells get finer as n grows."""
    k = 2
    while n > CELL_PRINTS << (64 * k // (radius + k)) and k < 8:
        k += 1
    return k


def block_cells(node, radius: int, equal: int) -> list:
    """Of a 64-bit print as a long: a number for each choice of so many of radius + equal blocks, and their bits.

    Prints that differ in at most radius bits have as many equal blocks, so they share a cell.
    """
    n = radius + equal
    size = [64 // n + (i < 64 % n) for i in range(n)]
    block = [F.shiftrightunsigned(node, sum(size[:i])).bitwiseAND((1 << size[i]) - 1) for i in range(n)]
    wide, out = sum(sorted(size)[-equal:]), []
    for k, some in enumerate(itertools.combinations(range(n), equal)):
        cell = F.lit(k).cast("long")
        for i in some:
            cell = F.shiftleft(cell, size[i]).bitwiseOR(block[i])
        # all choices take the same number of bits, so that numbers of different ones differ
        out.append(F.shiftleft(cell, wide - sum(size[i] for i in some)))
    return out


def grouped(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links).

    64-bit fingerprints link at radius or fewer differing bits; a radius over WIDEST is an error. One row per row of docs; rows that repeat a doc_id each have their own
    fingerprint. Rows without a doc_id link nothing and have no component.
    """
    if radius > WIDEST:
        raise ValueError(f"radius must be at most {WIDEST}")
    prepare(docs.sparkSession)
    # a 64-bit print is its own node number
    prints = fingerprints(docs, words).select("doc_id", "print", _as_long("print").alias("node")).checkpoint()
    distinct = prints.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("print").alias("print")).checkpoint()
    equal = blocks_for(distinct.count(), radius)
    cells = distinct.select("node", "print", F.bit_count("node").alias("pc"), F.explode(F.array(*block_cells(F.col("node"), radius, equal))).alias("cell"))
    roots = components(links(cells, radius, 64))
    return labelled(prints, distinct, roots).select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _as_long(column: str):
    """Eight little-endian bytes as a long."""
    h = F.hex(column)
    turned = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    high = F.conv(F.substring(turned, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(turned, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def labelled(prints: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """prints (doc_id, node) with component_id and root, from distinct (node, least doc_id) and roots (node, root)."""
    linked = distinct.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = linked.join(least, "root").select("node", "root", "component_id")
    return prints.join(of_node, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


#: For documents of a similarity: bits of a fingerprint, deviations by which prints of similar sets may differ beyond the
#: mean (odds of a lost link under 1e-8), sets up to which size count as small, and bytes of sets that a part holds.
WIDE, DEVIATIONS, SMALL, PART_BYTES = 128, 6, 24, 8 << 20
#: Bands of a set, and least values of each.
BANDS, BAND_ROWS = 28, 5


@functools.cache
def _hashers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 2**31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """A cell per band from a set of hashes; none of an empty one."""
    if not len(h):
        return np.zeros(0, np.int64)
    odd, weights = _hashers()
    short = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 256):
        np.minimum(least, (short[i : i + 256, None] * odd).min(0), out=least)
    x = (least.reshape(BANDS, BAND_ROWS) * weights).sum(1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def differing(a: int, b: int, shared: int) -> float:
    """Odds that a bit differs in the prints of sets of a and b hashes that share so many."""

    def odds(n):
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    def over(n):  # odds that over half of n are set, by how many of the shared ones are
        rest = odds(n - shared)
        return np.array([rest[max(0, n // 2 + 1 - k) :].sum() for k in range(shared + 1)])

    x, y = over(a), over(b)
    return float((odds(shared) * (x * (1 - y) + y * (1 - x))).sum())


@functools.cache
def radius_of(similarity: float, bits: int, least: int, most: int) -> int:
    """Bits by which prints of sets with this similarity, of least to most hashes the larger one, differ at most."""
    p = 0.0
    for a in range(least, most + 1):
        for b in range(max(1, math.ceil(similarity * a - 1e-9)), a + 1):
            shared = math.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)
            if shared <= b and shared < a:
                p = max(p, differing(a, b, shared))
    return round(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def text_digest(text: str):
    """A number that tells a doc_id's texts apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingle_sets(docs: DataFrame, words: int, bits: int = 0) -> DataFrame:
    """doc_id, digest (of the text), node (a digest of the set of shingle hashes), n (its size), and print and bands, or without bits the sorted set."""
    prepare(docs.sparkSession)

    def run(batches):
        for part, texts in blocks(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in texts]
            nodes = [np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64) for h in sets]
            data = [pa.array([(majority(h, bits) if bits else h).tobytes() for h in sets], pa.binary())]
            if bits:
                data.append(pa.array([bands(h) for h in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), *data], ["doc_id", "digest", "node", "n", *(["print", "bands"] if bits else ["set"])])

    return as_text(docs).withColumn("digest", text_digest("text")).mapInArrow(run, f"doc_id long, digest long, node long, n long, {'print binary, bands array<long>' if bits else 'set binary'}")


def similar(a: list[tuple[int, bytes]], b: list[tuple[int, bytes]], similarity: float) -> Iterator[tuple[int, int]]:
    """Links that connect all sets (node, sorted hashes) of a with those of b whose similarity is at least this one; exact."""
    nodes, inverse = np.unique(np.array([x for x, _ in a] + [x for x, _ in b], np.int64), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    hashes, codes = np.unique(np.concatenate([np.frombuffer(h, "<u8") for _, h in [*a, *b]]), return_inverse=True)
    n = np.array([len(h) // 8 for _, h in [*a, *b]])
    ends = np.cumsum(n)
    of = codes.astype(np.int32)
    place = [of[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    na, nb = n[: len(a)], n[len(a) :]
    label = np.arange(len(nodes))
    mine = np.zeros(len(hashes), bool)
    for i in range(len(a)):
        # sets that are connected already, or whose sizes tell, need no comparison
        js = np.flatnonzero((label[ib] != label[ia[i]]) & (np.minimum(nb, na[i]) >= similarity * np.maximum(nb, na[i]) - 1e-9) & (nb > 0))
        if not len(js):
            continue
        mine[place[i]] = True
        shared = np.add.reduceat(mine[np.concatenate([place[len(a) + j] for j in js])], np.cumsum(nb[js]) - nb[js], dtype=np.int64)
        mine[place[i]] = False
        for j in js[shared * (1 + similarity) >= similarity * (na[i] + nb[js]) - 1e-9]:
            x, y = label[ia[i]], label[ib[j]]
            if x != y:
                yield int(nodes[ia[i]]), int(nodes[ib[j]])
                label[label == y] = x


def confirmed(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect all sets (root, cell, node, n, set) of a root with at least this similarity; exact.

    Sets of a root and size cell are dealt into parts of bounded size by hash, and parts of the same or
    neighbouring cells meet in pairs.
    """
    sizes = sets.groupBy("root", "cell").agg(F.ceil(F.sum(8 * F.col("n") + 64) / PART_BYTES).alias("parts"))
    dealt = sets.join(sizes, ["root", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
    parts = sizes.select("root", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    others = parts.select("root", F.col("cell").alias("cell2"), F.col("part").alias("part2"))
    pairs = parts.join(others, "root").where("cell2 = cell + 1 or cell2 = cell and part2 >= part")
    first = dealt.join(pairs, ["root", "cell", "part"]).select("root", "cell", "part", "cell2", "part2", F.lit(0).alias("kind"), "node", "set")
    theirs = dealt.select("root", F.col("cell").alias("cell2"), F.col("part").alias("part2"), "node", "set")
    second = theirs.join(pairs.where("cell <> cell2 or part <> part2"), ["root", "cell2", "part2"]).select("root", "cell", "part", "cell2", "part2", F.lit(1).alias("kind"), "node", "set")

    def compare(batches):
        out, now, held = _Out(), None, ([], [])
        for batch in itertools.chain(batches, [None]):
            for r in batch.to_pylist() if batch is not None else [None]:
                key = r and tuple(r[k] for k in keys)
                if key != now:
                    if now is not None:
                        a, b = held
                        out.add(similar(a, a if now[1:3] == now[3:] else b, similarity) if a and (b or now[1:3] == now[3:]) else ())
                        for x in out.rows():
                            yield x.select(["a", "b"])
                    now, held = key, ([], [])
                if r:
                    held[r["kind"]].append((r["node"], r["set"]))
        for x in out.rows(last=True):
            yield x.select(["a", "b"])

    keys = ["root", "cell", "part", "cell2", "part2"]
    met = first.union(second).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(compare, "a array<long>, b array<long>").select(F.inline(F.arrays_zip("a", "b")))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = WIDE) -> DataFrame:
    """doc_id, digest, root and component_id of documents linked by the similarity of their sets of shingles.

    Groups may share the least doc_id where rows with different texts do; their roots differ.

    Prints find candidates in cells of bands at a radius that sets of the similarity keep to; groups of candidates are
    then compared by their sets, so that links are exact. Rows without a doc_id link nothing and have no component.
    """
    prepare(docs.sparkSession)
    prints = shingle_sets(docs, words, bits).checkpoint()
    distinct = prints.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("print").alias("print"), F.first("bands").alias("bands"), F.first("n").alias("n")).checkpoint()
    rows = distinct.select(F.explode("bands").alias("cell"), _population("print", bits).alias("pc"), "node", "print", "n")
    # in prints of small sets bits differ oftener: they have a radius of their own
    small, large = rows.where(F.col("n") <= SMALL), rows.where(F.col("n") >= similarity * (SMALL + 1) - 1e-9)
    near_small = links(small, radius_of(similarity, bits, 1, SMALL), bits)
    near_large = links(large, radius_of(similarity, bits, SMALL + 1, 4 * SMALL), bits)
    candidates = components(near_small.union(near_large)).checkpoint()
    size_class = F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similarity) + 1e-9)).otherwise(-9).cast("long")
    wanted = distinct.join(candidates, "node").select("node", "least", size_class.alias("cell"), "root").checkpoint()
    texts = docs.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = shingle_sets(texts, words).join(wanted, "node").groupBy("node", "root", "cell").agg(F.first("n").alias("n"), F.first("set").alias("set")).checkpoint()
    roots = components(confirmed(sets, similarity))
    return labelled(prints.select("doc_id", "digest", "node"), distinct, roots).select("doc_id", "digest", "root", "component_id")


def _population(column: str, bits: int):
    words = [F.conv(F.substring(F.hex(column), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(bits // 32)]
    total = F.bit_count(words[0])
    for w in words[1:]:
        total = total + F.bit_count(w)
    return total
