"""Full-text search, vector search, and duplicates."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode import schemas as S
from codelode.functions import scalars as X
from codelode.session import cut

#: Vectors of a block; blocks are compared as matrices.
BLOCK = 2048
#: Texts that an embedder is given at once.
TEXTS = 256
#: Bytes of a part of a cell, which a task holds; pivots at most.
GROUP_BYTES, MOST_PIVOTS = 1 << 26, 2048
#: Groups that a table without telling bounds is dealt to at least, rows that a group is worth, held vectors that a block meets at once, and the part of the block.
GROUPS, LEAST_ROWS, TILE, STRIP = 64, 2048, 4096, 256


def fulltext(files: DataFrame, words: Sequence[str], text: str = "content") -> DataFrame:
    """relative_path of the text files that hold any of the words, whatever their case."""
    return files.where(X.is_text_file("relative_path") & X.contains_any(text, words)).select("relative_path")


def fulltext_many(files: DataFrame, words: Sequence[str], text: str = "content") -> DataFrame:
    """As fulltext, for thousands of words: one pass by an automaton that each worker builds once."""
    wanted = sorted({w.strip().lower() for w in words if w.strip()})

    @F.pandas_udf("boolean")
    def found(batches: "pd.Series") -> "pd.Series":
        try:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in wanted:
                a.add_word(w, w)
            a.make_automaton()
            has = lambda t: next(a.iter(t), None) is not None
        except ImportError:
            has = re.compile("|".join(map(re.escape, wanted))).search
        return batches.str.lower().fillna("").map(lambda t: bool(has(t)))

    if not wanted:
        return files.where(F.lit(False)).select("relative_path")
    return files.where(X.is_text_file("relative_path")).where(found(F.col(text))).select("relative_path")


def vector_topk(chunks: DataFrame, query: Sequence[float], k: int = S.SEARCH_TOP_K) -> DataFrame:
    """chunk_id and score of the k chunks nearest to a query vector by cosine, ties by chunk_id."""
    q = X.literal_vector(query)
    scored = chunks.where("embedding is not null").select("chunk_id", X.cosine("embedding", q).alias("score"))
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def _units(chunks: DataFrame) -> DataFrame:
    """id and v: unit vectors; NaN counts as 0, null, zero and infinite vectors are left out.

    Rows are dealt anew, since a table of few files would be worked on in few tasks.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(1))))
            starts = np.concatenate([[0], ends[:-1]])
            x = np.asarray(batch.column(1).flatten())
            x = np.where(np.isnan(x), 0.0, x)
            most = np.maximum.reduceat(np.abs(x), starts)
            n = np.diff(np.concatenate([[0], ends]))
            # squares of very large numbers would be infinite
            x = x / np.where((most > 1e150) & np.isfinite(most), most, 1.0).repeat(n)
            long = np.sqrt(np.add.reduceat(x * x, starts))
            ok = (long > 0) & np.isfinite(long)
            v = x / np.where(ok, long, 1.0).repeat(n)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(v))], ["id", "v"]).filter(pa.array(ok))

    rows = chunks.where("size(embedding) > 0 and not exists(embedding, x -> x is null)").select(F.col("chunk_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.repartition("id").mapInArrow(run, "id string, v array<double>")


def pivots(units: DataFrame, n: int, least: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """ids and vectors of a sample of n rows (those with the least hash of their id), and the pivots chosen among them.

    Each pivot is the vector that is farthest from those before it, as long as that is farther than a bound by the angle of
    the least cosine can tell apart. So there are as many as the vectors have separate directions, at most the
    square root of the rows; without a cosine above 0.5, which tells little apart, a pivot for each 4,096 rows.
    """
    apart, most = (2 * math.sqrt(1 - min(least, 1) ** 2), math.isqrt(n)) if least > 0.5 else (0.0, n // 4096)
    most = min(most, MOST_PIVOTS)
    if not n:
        return [], np.zeros((0, 1)), np.zeros((1, 1))
    found = units.orderBy(F.xxhash64("id"), "id").limit(min(n, 2 * MOST_PIVOTS)).collect()  # megabytes at most
    v = np.array([r["v"] for r in found])
    chosen, away = [0], np.sqrt(np.maximum(2 - 2 * v @ v[0], 0))
    while len(chosen) < most and away.max() > max(apart, 1e-6):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.sqrt(np.maximum(2 - 2 * v @ v[chosen[-1]], 0)))
    return [r["id"] for r in found], v, v[chosen]


class Cells:
    """Vectors by the nearest of some pivots, and which other cells can hold a neighbour of a vector.

    Let u be the direction from pivot j to a vector's own pivot i. What lies in cell j is not nearer to i than to j, so its
    product with u is not above 0. A vector whose product with u is over sin t is more than the angle t away from all of
    these, by the triangle inequality, and need not go there. t is the angle of the least cosine that is asked
    for or, if k nearest are, of the k-th best vector of the sample that the pivots are from.
    """

    def __init__(self, ids: list[str], sample: np.ndarray, vectors: np.ndarray, k: int | None, least: float):
        self.sample, self.vectors, self.k, self.least = sample, vectors, k, least
        self.apart = np.sqrt(np.maximum(2 - 2 * vectors @ vectors.T, 0))
        #: which rows of the sample have an id
        self.at: dict[str, list[int]] = {}
        for i, x in enumerate(ids):
            self.at.setdefault(x, []).append(i)
        #: how many slices visitors are dealt to, each of which meets all parts
        self.slices = 1

    def own(self, v: np.ndarray) -> np.ndarray:
        return (v @ self.vectors.T).argmax(1) if len(self.vectors) > 1 else np.zeros(len(v), int)

    def bounds(self, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        """A cosine for each vector that all its neighbours have at least."""
        bound = np.full(len(v), float(self.least))
        if self.k is not None and self.k < len(self.sample):
            s = v @ self.sample.T
            for i, x in enumerate(ids):
                s[i, self.at.get(x, [])] = -np.inf
            bound = np.maximum(bound, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        return bound

    def reached(self, v: np.ndarray, own: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each vector and cell whether it has to go there; its own always."""
        if len(self.vectors) < 2:
            return np.ones((len(v), 1), bool)
        sine = np.where(bound > 0, np.sqrt(np.maximum(1 - bound**2, 0)), np.inf)
        s = v @ self.vectors.T
        margin = s[np.arange(len(v)), own][:, None] - s
        return margin <= np.minimum(sine[:, None], 2) * self.apart[own] + 1e-9


PLACED = "grp long, kind int, ids array<string>, vectors binary, bounds binary"


def placed(units: DataFrame, cells: Cells, parts: dict[int, int]) -> DataFrame:
    """grp, kind, ids, vectors, bounds: packed blocks of unit vectors, kind 0 in one part of their cell and kind 1, with the bounds of
    their neighbours, in all parts of those that they reach.

    parts says how many parts a cell has, one if it isn't named. A vector visits one slice of each part, and is held by all slices of its part.
    """
    n, slices = len(cells.vectors), cells.slices
    most = max(parts.values(), default=1)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ids, v = pdf["id"].to_numpy(dtype=object), np.stack(pdf["v"]).astype("<f8")
            own = cells.own(v)
            # bounded, however many cells there are
            step = max(1, (1 << 21) // max(n, len(cells.sample), 1))
            bound = np.concatenate([cells.bounds(ids[a : a + step], v[a : a + step]) for a in range(0, len(ids), step)])
            to = np.concatenate([cells.reached(v[a : a + step], own[a : a + step], bound[a : a + step]) for a in range(0, len(ids), step)])
            turn = np.arange(len(ids))
            for c in np.flatnonzero(to.any(0)).tolist():
                of = parts.get(c, 1)
                group = lambda part, slice_: (c * most + part) * slices + slice_  # noqa: B023, E731
                for kind, rows, ways in ((0, np.flatnonzero(own == c), of), (1, np.flatnonzero(to[:, c]), slices)):
                    for way in range(ways):
                        mine = rows[turn[: len(rows)] % ways == way]
                        for i in range(0, len(mine), BLOCK):
                            w = mine[i : i + BLOCK]
                            block = (ids[w].tolist(), v[w].tobytes(), bound[w].tobytes() if kind else b"")
                            groups = [group(way, x) for x in range(slices)] if kind == 0 else [group(x, way) for x in range(of)]
                            for g in groups:
                                yield pd.DataFrame([(g, kind, *block)], columns=["grp", "kind", "ids", "vectors", "bounds"])

    return units.mapInPandas(run, PLACED)


def cells_of(units: DataFrame, k: int | None, least: float) -> tuple[Cells, dict[int, int]]:
    """Cells for a table of unit vectors, and the parts of those that hold more than a task is to hold.

    Where vectors of the sample reach half of the cells, these tell little apart: then there is one cell, and parts and
    slices alike, so that each vector travels twice the square root of the number of groups.
    """
    n = units.count()
    ids, sample, vectors = pivots(units, n, least)
    cells, dim = Cells(ids, sample, vectors, k, least), max(sample.shape[1], 1)
    rows = max(GROUP_BYTES // (8 * dim), 1024)
    if len(vectors) > 1:
        some = slice(0, 512)
        v = sample[some]
        if cells.reached(v, cells.own(v), cells.bounds(np.array(ids[some], dtype=object), v)).mean() < 0.5:
            rows = min(max(n // 8, 1024), rows)
        else:
            cells = Cells(ids, sample, vectors[:1], k, least)
    if len(cells.vectors) < 2:
        side = min(math.isqrt(GROUPS), math.isqrt(n // LEAST_ROWS) + 1)
        cells.slices = side
        return cells, {0: max(side, -(-n // rows))}

    def count(batches):
        for pdf in batches:
            if len(pdf):
                c, m = np.unique(cells.own(np.stack(pdf["v"])), return_counts=True)
                yield pd.DataFrame({"cell": c, "n": m})

    sizes = units.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > rows)
    return cells, {r["cell"]: -(-r["n"] // rows) for r in sizes.collect()}  # at most one row a pivot


class Held:
    """Vectors of a group, equal ones once, each with the rows that bear it, in the order of their ids.

    Of rows with equal vectors k of each of the first k + 1 ids are enough for the k nearest of any vector.
    """

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray], k: int | None, least: float):
        names, v = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(names, kind="stable")
        names, v = names[order], np.ascontiguousarray(v[order])
        _, first, of = np.unique(v.view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        row = np.argsort(of, kind="stable")
        if k is not None and len(first) < len(names):
            vector = of[row]
            new = np.concatenate([[True], vector[1:] != vector[:-1]])
            other = new | np.concatenate([[True], names[row][1:] != names[row][:-1]])
            at = np.arange(len(row))
            since = lambda marks: np.maximum.accumulate(np.where(marks, at, 0))
            nth = np.cumsum(other)
            row = row[(nth - nth[since(new)] <= k) & (at - since(other) < k)]
        self.names, self.v, self.k, self.least = names, v[first], k, least
        self.row, self.start = row, np.searchsorted(of[row], np.arange(len(first) + 1))
        self.short = self.v.astype(np.float32)
        # products of rounded numbers differ from the exact ones by less
        self.margin = (v.shape[1] + 8) * 2.0**-23

    def near(self, ids: np.ndarray, v: np.ndarray, low: np.ndarray):
        """Visitors' numbers, rows and scores of neighbours with low at least, tile by tile: the k nearest of all if there is a k.

        Products of four-byte numbers tell which pairs can be such; only these are worked out in eight bytes.
        """
        short, k = v.astype(np.float32), self.k
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # the same memory for all products
        products, over = np.empty(STRIP * TILE, np.float32), np.empty(STRIP * TILE, bool)
        for a in range(0, len(self.v), TILE):
            tile, least = self.short[a : a + TILE], (low - self.margin).astype(np.float32)[:, None]
            hits = []
            for x in range(0, len(v), STRIP):
                n = min(STRIP, len(v) - x)
                s, o = (m[: n * len(tile)].reshape(n, -1) for m in (products, over))
                np.matmul(short[x : x + n], tile.T, out=s)
                np.greater_equal(s, least[x : x + n], out=o)
                hits.append(np.flatnonzero(o) + x * len(tile))
            hits = np.concatenate(hits)
            for b in range(0, len(hits), 1 << 16):
                i, u = np.divmod(hits[b : b + (1 << 16)], len(tile))
                u += a
                score = np.round(np.einsum("ij,ij->i", v[i], self.v[u]), 12)  # so that equal vectors tie, whatever block they are in
                ok = score >= np.maximum(low[i], self.least) - 1e-12
                i, u, score = i[ok], u[ok], score[ok]
                n = self.start[u + 1] - self.start[u]
                row = self.row[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[u], n)]
                i, score = np.repeat(i, n), np.repeat(score, n)
                apart = self.names[row] != ids[i]
                found = i[apart], row[apart], score[apart]
                if k is None:
                    yield found
                    continue
                i, row, score = (np.concatenate(x) for x in zip(best, found, strict=True))
                order = np.lexsort((row, -score, i))
                i, row, score = i[order], row[order], score[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                best = i[nth < k], row[nth < k], score[nth < k]
                last = nth == k - 1
                low = low.copy()
                low[i[last]] = np.maximum(low[i[last]], score[last])
        if k is not None:
            yield best


def neighbours(chunks: DataFrame, k: int | None = S.DUPLICATE_TOP_K, least: float = -1.0) -> DataFrame:
    """id, other, score: each vector's k nearest others with at least this cosine, ties by other; all such if k is None.

    Exact. Packed blocks of vectors travel to the cells that can hold a neighbour (Cells) and are compared there by
    matrix products. A task holds one part of a cell, GROUP_BYTES or so, and a block that visits. How
    many cells a vector visits follows from how the vectors lie and from the bound, not from how many there are; vectors that no
    bound tells apart are all compared, in time that grows with their square.
    """
    units = cut(_units(chunks))
    cells, parts = cells_of(units, k, least)

    def compare(batches):
        now, ids, vectors, held = None, [], [], None
        for pdf in batches:
            for r in pdf.itertuples():
                if r.grp != now:
                    now, ids, vectors, held = r.grp, [], [], None
                names = np.array(r.ids, dtype=object)
                v = np.frombuffer(r.vectors, "<f8").reshape(len(names), -1)
                if r.kind == 0:
                    ids.append(names)
                    vectors.append(v)
                    continue
                if held is None and ids:
                    held = Held(ids, vectors, k, least)
                    ids, vectors = [], []
                if held is not None:
                    for i, row, score in held.near(names, v, np.frombuffer(r.bounds, "<f8") - 1e-9):
                        yield pd.DataFrame({"id": names[i], "other": held.names[row], "score": score})

    groups = max(len(cells.vectors), 1) * max(parts.values(), default=1) * cells.slices
    blocks = placed(units, cells, parts)
    # in one cell each group is a task of its own
    dealt = blocks.repartitionById(groups, F.col("grp").cast("int")) if len(cells.vectors) < 2 else blocks.repartition("grp")
    found = dealt.sortWithinPartitions("grp", "kind").mapInPandas(compare, "id string, other string, score double").where(F.col("score") >= least)
    if k is None:
        return found
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def duplicate_pairs(chunks: DataFrame, least: float = S.DUPLICATE_SIMILARITY, k: int | None = S.DUPLICATE_TOP_K) -> DataFrame:
    """id_a, id_b, similarity: unordered pairs among each vector's k nearest with at least this cosine."""
    found = neighbours(chunks, k, least)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "score").groupBy("id_a", "id_b").agg(F.max("score").alias("similarity"))


def with_places(pairs: DataFrame, chunks: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """pairs (id_a, id_b, similarity) with path, lines and content of both chunks."""
    key = ["repo_id", "branch"]
    text = chunks.join(files.select(*key, "relative_path", "blob_hash"), [*key, "relative_path", "blob_hash"]).join(blobs, [*key, "blob_hash"])
    of = lambda s: text.select(F.col("chunk_id").cast("string").alias(f"id_{s}"), F.col("relative_path").alias(f"path_{s}"), F.col("start_line").alias(f"start_line_{s}"), F.col("end_line").alias(f"end_line_{s}"), X.slice_content("content", "start_char", "end_char").alias(f"content_{s}"))
    return pairs.join(of("a"), "id_a", "left").join(of("b"), "id_b", "left")


def duplicate_pairs_lsh(chunks: DataFrame, least: float = S.DUPLICATE_SIMILARITY, tables: int = 8, bits: int = 12, dim: int = 64, seed: int = 1) -> DataFrame:
    """As duplicate_pairs with k=None, by random hyperplanes: near duplicates share a bucket in some table with high probability.

    Buckets hold near copies only; recall is below 1, the exact form is the default.
    """
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, bits, dim))
    units = _units(chunks)

    @F.pandas_udf("array<bigint>")
    def buckets(v: "pd.Series") -> "pd.Series":
        m = np.stack(v)
        codes = [((m @ p.T) > 0) @ (1 << np.arange(bits)) + (t << bits) for t, p in enumerate(planes)]
        return pd.Series(list(np.stack(codes, 1)))

    keyed = units.withColumn("bucket", F.explode(buckets("v")))
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, F.col("a.bucket") == F.col("b.bucket")).where("a.id < b.id").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), X.dot("a.v", "b.v").alias("similarity"))
    return pairs.where(F.col("similarity") >= least).dropDuplicates(["id_a", "id_b"])


def exact_copies(files: DataFrame, key: str = "relative_path", text: str = "content") -> DataFrame:
    """blob_hash, n, first, members: groups of files with the same content."""
    g = files.groupBy(X.content_hash(text).alias("blob_hash")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.array_sort(F.collect_list(key)).alias("members"))
    return g.where("n > 1")


def hashed_embedding(chunks: DataFrame, dim: int = 64, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """key and embedding: the offline default embedder, signed hashes of words summed and normalised.

    Another embedder is any function of the same form, given to embed().
    """

    def words(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed(chunks, words, key, text)


def embed(chunks: DataFrame, model, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """key and embedding by a function from texts to a matrix; NaN becomes 0.

    A batch is worked on in parts, so that a worker holds TEXTS texts and their vectors beside it, however many or long its rows are.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                texts = [x or "" for x in part.column(1).to_pylist()]
                m = np.nan_to_num(np.asarray(model(texts), dtype=np.float32), nan=0.0).reshape(len(texts), -1)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], [key, "embedding"])

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, F.col(text).alias("_text")).mapInArrow(run, f"{key} {kind}, embedding array<float>")
