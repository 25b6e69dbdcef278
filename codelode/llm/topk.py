"""Exact search for the largest inner products.

Candidates lie in groups by descending length. A group's vectors and the queries are rotated into the
basis of the singular vectors of a sample, so that a few leading coordinates hold most of a product;
what the others can add is bounded by Cauchy and Schwarz. A query that already has k products, first
of all those with the longest vectors, skips each chunk whose longest vector can't reach the least of
them, and each candidate whose partial sum and bound can't. What is left is computed exactly.

The basis only decides how much is skipped, so a bounded sample is enough for it.
Queries travel in packs to the groups of candidates whose longest vector can still reach what the query
has; since groups are by length, these are the first ones. A task holds one group and one pack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import prepare
from codelode.llm.labelled import lowest

#: Rows of a group of candidates, of a chunk of it, of a pack of queries, and of the sample for the basis.
GROUP_ROWS, CHUNK_ROWS, PACK_ROWS, SAMPLE_ROWS = 16_384, 2_048, 1_024, 4_096
#: Leading coordinates that are summed first.
LEADING = 16
PACK = "grp int, kind int, seq long, n int, ids binary, vectors binary, longest double"


def usable(df: DataFrame, scale: float) -> DataFrame:
    """vec_id, embedding and length (near enough to order by) of the rows that take part: no null, none null or non-finite inside, scaled or not."""
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    v = v.where(F.forall("embedding", lambda x: F.abs(x * scale) < F.lit(float("inf"))))
    # whole numbers of a double; floor() of Spark would be a long
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.rint(x * scale), 2.0))
    return v.withColumn("length", F.sqrt(square))


def whole(vectors: list, width: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), padded with zeros to the same width."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


#: Components from which products may leave the range of a double; bounds are then kept in longer numbers.
WIDE = 2.0**400


def roomy(rows: np.ndarray) -> np.ndarray:
    """rows, in numbers of a wider range where they need it."""
    return rows.astype(np.longdouble) if rows.size and np.abs(rows).max() >= WIDE else rows


def lengths(rows: np.ndarray) -> np.ndarray:
    rows = roomy(rows)
    return np.sqrt((rows * rows).sum(1))


def limbs(rows: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers as parts of so many bits, the least first: rows = sum of part i times 2^(i * bits). All steps are exact."""
    out = []
    while rows.any():
        low = np.fmod(rows, 2.0**bits)
        out.append(low)
        rows = (rows - low) * 2.0**-bits
    return out or [rows]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; as int64, or as Python's integers where some may not fit.

    Numbers too large for sums of doubles are split into parts whose products are exact. Scores that fit a long are put
    together in wrapping integers; pairs of vectors so long that a score may not are done with Python's integers.
    """
    la, lb = lengths(a), lengths(b)
    if not a.size or not b.size or la.max() * lb.max() < 2**52:
        return np.rint(a @ b.T).astype(np.int64)
    bits = (52 - a.shape[1].bit_length()) // 2
    fit_a, fit_b = la * lb.min() < 2**62, lb * la.min() < 2**62  # others fit with no row of the other side
    own, other = (limbs(np.where(fit[:, None], m, 0), bits) for fit, m in ((fit_a, a), (fit_b, b)))
    out = np.zeros((len(a), len(b)), np.int64)
    for i, p in enumerate(own):
        for j, q in enumerate(other):
            if (i + j) * bits < 64:
                out += (p @ q.T).astype(np.int64) << ((i + j) * bits)
    large = la[:, None] * lb[None, :] >= 2**62
    if not large.any():
        return out
    out = out.astype(object)
    r, c = np.flatnonzero(large.any(1)), np.flatnonzero(large.any(0))
    own, other = ([[int(x) for x in row] for row in m] for m in (a[r], b[c]))
    for i, p in zip(r.tolist(), own, strict=True):
        for j, q in zip(c.tolist(), other, strict=True):
            if large[i, j]:
                out[i, j] = sum(x * y for x, y in zip(p, q, strict=True))
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:  # all that reach the k-th score, then in order
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


#: The range of a long.
LOW, HIGH = -(2**63), 2**63 - 1


def beyond(score: int) -> bytes | None:
    """What orders scores that lie outside the range of a long, or at its ends; None for others."""
    return (int(score) + 2**2303).to_bytes(288, "big") if not LOW < score < HIGH else None


def as_bound(score) -> np.longdouble:
    """A score as a number that bounds are compared with."""
    return np.longdouble(score) if LOW < score < HIGH else np.longdouble(str(score))


def slack(length: np.ndarray, longest: float) -> np.ndarray:
    """How far rounding may have put a product of vectors of these lengths."""
    return length * longest * 1e-9 + 1e-6


class Group:
    """Candidates in memory: chunks by descending length, each with its rotated leading part."""

    def __init__(self, packs: list[tuple[np.ndarray, np.ndarray]], basis: np.ndarray):
        ids = np.concatenate([p[0] for p in packs])
        rows = np.concatenate([p[1] for p in packs])
        length = lengths(rows)
        order = np.argsort(-length, kind="stable")
        self.chunks = []
        for i in range(0, len(order), CHUNK_ROWS):
            at = order[i : i + CHUNK_ROWS]
            lead, rest = rotated(rows[at], basis)
            self.chunks.append((ids[at], rows[at], length[at[0]], lead, rest))

    def search(self, ids: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int, basis: np.ndarray):
        """(query, candidate, score) of each query's k best here, of those that reach least."""
        lead, rest = rotated(rows, basis)
        length = lengths(rows)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        least = least.astype(np.longdouble)
        open_ = np.arange(len(ids))
        for cids, crows, longest, clead, crest in self.chunks:
            spare = slack(length, longest)
            open_ = open_[(length * longest + spare >= least)[open_]]
            if not len(open_):
                break
            bound = lead[open_] @ clead.T + np.outer(rest[open_], crest)
            bound += spare[open_, None]
            near = bound >= least[open_, None]
            some = np.flatnonzero(near.any(1))
            cols = np.flatnonzero(near[some].any(0))
            if not len(cols):
                continue
            exact = products(rows[open_[some]], crows[cols])
            for i, row in zip(some.tolist(), exact, strict=True):
                q = open_[i]
                mine = near[i, cols] & (cids[cols] != ids[q])
                if row.dtype != object:
                    mine &= row >= least[q]
                if mine.any():
                    c = np.concatenate([found[q][0], cids[cols][mine]])
                    s = np.concatenate([found[q][1], row[mine]])
                    at = best(c, s, k)
                    found[q] = (c[at], s[at])
                    if len(at) == k:
                        least[q] = max(least[q], as_bound(s[at[-1]]))
        for q, (c, s) in enumerate(found):
            for x, y in zip(c.tolist(), s.tolist(), strict=True):
                yield int(ids[q]), x, y


def rotated(rows: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated coordinates, and the length of what is left."""
    rows = roomy(rows)
    lead = rows @ basis[:, :LEADING]
    return lead, np.sqrt(np.maximum((rows * rows).sum(1) - (lead * lead).sum(1), 0))


def top_k(df: DataFrame, queries: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to smaller vec_id.

    Vectors hold floor(scale * x) for each component x. Queries are the vec_ids of rows for which
    queries is true; rows with a query's own vec_id are no candidates for it. Rows whose vec_id or
    embedding is null, or whose embedding holds a null or a number that is not finite, or not when scaled, take no part. Shorter
    vectors count as padded with zeros. Of a query's repeated rows the least vector counts; repeated
    candidates are each ranked. Products are exact and ranked as they are, however large; a score outside the
    range of a long is given as the end of that range. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = prepare(df.sparkSession)
    vectors = usable(df, scale)
    n, width = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], result)
    width = max(width, 1)
    sample = lowest(vectors.select("vec_id", "embedding"), SAMPLE_ROWS, "vec_id").select("embedding").collect()
    own = whole([r[0] for r in sample], width, scale)
    own /= max(np.abs(own).max(initial=0), 1.0)  # so that no square leaves the range of a double
    basis = np.linalg.svd(own.T @ own)[0]

    def pack(batches):
        task = TaskContext.get().partitionId()
        for seq, (ids, rows) in enumerate(_packed(batches, width, scale)):
            yield _pack(task, 0, seq, ids, rows)

    groups = -(-n // GROUP_ROWS)
    by_length = vectors.repartitionByRange(groups, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    candidates = by_length.select("vec_id", "embedding").mapInArrow(pack, PACK).checkpoint()
    # a number for each group, of GROUP_ROWS rows, and the one pack that begins with the longest vector, whose size is bounded
    found = candidates.groupBy("grp").agg(F.max("longest").alias("longest")).orderBy(F.desc("longest"), "grp").collect()
    numbers, reach = np.array([r["grp"] for r in found], np.int32), np.array([r["longest"] for r in found])
    head = unpacked(candidates.orderBy(F.desc("longest"), "grp", "seq").limit(1).collect()[0], width)
    bounds = spark.sparkContext.broadcast((numbers, reach, head))
    asked = df.where(queries).select("vec_id", "embedding")
    asked = usable(asked, scale).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def send(batches):
        """A pack of queries for each group that some of them need."""
        numbers, reach, head = bounds.value
        task, seq = TaskContext.get().partitionId(), 0
        for ids, rows in _packed(batches, width, scale):
            least, length = first_least(ids, rows, head, k), lengths(rows)
            for group, longest in zip(numbers.tolist(), reach.tolist(), strict=True):
                # a product of nothing and a length beyond all doubles counts as one that reaches
                near = ~(length * longest + slack(length, longest) < least)
                if not near.any():
                    break
                yield _pack(group, 1, (task << 20) + seq, ids[near], rows[near])
            seq += 1

    packs = asked.select("vec_id", "embedding").mapInArrow(send, PACK)

    def search(batches):
        group, held, now = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] != now:
                    group, held, now = None, [], row["grp"]
                if row["kind"] == 0:
                    held.append(unpacked(row, width))
                    continue
                if group is None:
                    group, held = Group(held, basis), []
                ids, rows = unpacked(row, width)
                found = list(group.search(ids, rows, first_least(ids, rows, head, k), k, basis))
                if found:
                    q, c, s = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array([min(max(x, LOW), HIGH) for x in s], pa.int64()), pa.array(list(map(beyond, s)), pa.binary())], ["query_id", "vec_id", "score", "beyond"])

    dealt = candidates.unionByName(packs).repartition(len(numbers), "grp").sortWithinPartitions("grp", "kind", "seq")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(batches, width: int, scale: float):
    """ids and rows of at most PACK_ROWS vectors at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, PACK_ROWS):
            part = batch.slice(i, PACK_ROWS)
            yield np.asarray(part.column(0)), whole(part.column(1).to_pylist(), width, scale)


def _pack(group: int, kind: int, seq: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    values = [group, kind, seq, len(ids), ids.astype("<i8").tobytes(), rows.astype("<f8").tobytes(), float(lengths(rows).max())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS, strict=True)], _NAMES)


def first_least(ids: np.ndarray, rows: np.ndarray, head: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """For each query, what the k-th highest product with the longest vectors surely reaches; minus infinity if there are fewer."""
    scores = roomy(rows) @ roomy(head[1]).T
    scores[ids[:, None] == head[0][None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(ids), -np.inf)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return least - slack(lengths(rows), lengths(head[1]).max())


def unpacked(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, width)


_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64()]
_NAMES = [x.split()[0] for x in PACK.split(", ")]
