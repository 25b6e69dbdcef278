"""A linear toxicity classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are whether a text holds an n-gram of 3 to 5 characters of its lower-case form, hashed into
2^18 buckets. A bucket's scale is the log ratio of its smoothed shares in toxic and other labelled
texts, the smaller the less certain it is. A logistic regression is fitted on the scaled features of all buckets that were met; its penalty
keeps those small that say little. So many features know their own rows by heart, so probabilities come
from margins of rows that a fit hasn't seen: the same is fitted without each third of the rows in turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import as_text, prepare
from codelode.llm.labelled import calibrated, fit_logistic, sample, sigmoid
from codelode.llm.pieces import blocks

ORDERS, BITS = (3, 4, 5), 18
#: Labelled rows that the model is fitted on at most, features of all of them at most, the smoothing of shares, and the
#: square of a ratio over its error at which a scale is half of it.
MOST_ROWS, MOST_ENTRIES, SMOOTHING, CERTAIN = 4_000, 1 << 25, 1.0, 16.0
#: Parts of the rows that are left out in turn.
PARTS = 3
#: Characters that are hashed at once (a longer text is hashed whole).
CHARS = 400_000


def hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: buckets of the n-grams of all texts, and the text that each is from."""
    low = [t.lower() for t in texts]
    n = np.array([len(t) for t in low], np.int64)
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(low), dtype=np.int32), n)
    h = c
    for size in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[size - 1 :] if len(h) > 1 else h[:0]
        if size in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * size)
            inside = of[: len(h)] == of[size - 1 :] if len(h) else np.zeros(0, bool)
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int32)[inside], of[: len(h)][inside]


def packed(own: np.ndarray) -> bytes:
    """Distinct buckets in ascending order by their gaps, which mostly are of one byte: the driver gets less than half of what the numbers take."""
    return zlib.compress(np.diff(np.sort(own), prepend=0).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int32)


class Present:
    """Finds the buckets of a text's n-grams, each once, without sorting: of those that write their place into a bucket's field, the last one stays."""

    def __init__(self):
        self.place = np.zeros(1 << BITS, np.int32)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        found = list(hashed(texts))
        cuts = [np.searchsorted(of, np.arange(len(texts) + 1)) for _, of in found]
        for i in range(len(texts)):
            own = np.concatenate([bucket[c[i] : c[i + 1]] for (bucket, _), c in zip(found, cuts, strict=True)])
            at = np.arange(len(own), dtype=np.int32)
            self.place[own] = at
            yield own[self.place[own] == at]


@dataclass
class Model:
    """weights: regression weight times scale, by bucket; 0 for buckets that weren't met."""

    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str]) -> np.ndarray:
        present = Present()
        return sigmoid(np.array([self.weights[own].sum() for own in present(texts)]) + self.intercept)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    """The model for labels (doc_id, toxic) of docs (doc_id, text), fitted on at most so many labelled rows, those with the
    smallest hash of doc_id, and on no more of them than have MOST_ENTRIES features together.

    Labels of ids that docs lacks are ignored; of rows that share id and label one counts. Without any usable label, or
    with one class alone, all scores are the smoothed share of toxic labels, 0.25 if there are none.
    """
    prepare(docs.sparkSession)
    known = as_text(docs).join(F.broadcast(sample(labels, "toxic", most)), "doc_id")

    def select(batches):
        present = Present()
        for part, texts in blocks(batches, chars=CHARS):
            own = list(present(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in own], pa.int64()), pa.array([packed(x) for x in own], pa.binary())], ["doc_id", "label", "n", "features"])

    chosen = known.select("doc_id", "label", "text").mapInArrow(select, "doc_id long, label int, n long, features binary")
    one = chosen.groupBy("doc_id", "label").agg(F.min(F.struct("n", "features")).alias("x")).select("doc_id", "label", "x.*").checkpoint()
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")
    # numbers of at most `most` rows
    upto = one.select("doc_id", "label", F.sum("n").over(Window.orderBy(*order)).alias("upto"))
    rows = one.join(F.broadcast(upto.where(F.col("upto") <= MOST_ENTRIES)), ["doc_id", "label"]).orderBy(*order).select("label", "features").collect()
    y, own = np.array([r[0] for r in rows], np.int64), [unpacked(r[1]) for r in rows]
    del rows
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 2)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    weights, intercept = fit_scaled(own, y)
    part = np.empty(len(y), np.int64)
    part[np.argsort(y, kind="stable")] = np.arange(len(y)) % PARTS  # in each as many toxic ones
    margin = np.full(len(y), np.nan)
    for k in range(PARTS):
        rest = np.flatnonzero(part != k)
        if 0 < y[rest].sum() < len(rest):
            w, b = fit_scaled([own[i] for i in rest], y[rest])
            for i in np.flatnonzero(part == k).tolist():
                margin[i] = w[own[i]].sum() + b
    seen = np.isfinite(margin)
    slope, shift = calibrated(margin[seen], y[seen])
    return Model(slope * weights, slope * intercept + shift)


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """By bucket, the log ratio of its smoothed shares in rows of label 1 and 0, times z / (z + CERTAIN) for z its square over its variance; 0 for buckets that weren't met."""
    q, p = np.zeros((2, 1 << BITS))
    for own, label in zip(rows, y.tolist(), strict=True):
        (p if label else q)[own] += 1
    met = np.flatnonzero(p + q)
    p, q = p[met] + SMOOTHING, q[met] + SMOOTHING
    out = np.zeros(1 << BITS)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    z = ratio**2 / (1 / p + 1 / q)
    out[met] = ratio * z / (z + CERTAIN)
    return out


def fit_scaled(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket, times the buckets' scales, and intercept."""
    scale = log_ratios(rows, y)
    w, intercept = fit_logistic(rows, y, scale)
    return w * scale, intercept


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, one row per row of docs.

    Null texts count as empty; a text without any n-gram has the score of the intercept. Other
    columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in blocks(batches, chars=CHARS):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(texts))], ["doc_id", "score"])

    return as_text(docs).mapInArrow(run, "doc_id long, score double")


def score_of(model: Model, spark):
    """The score as a column function of a text column."""
    shared = prepare(spark).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        texts = text.fillna("").tolist()
        out, at, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHARS or i + 1 == len(texts):
                out.append(shared.value.score(texts[at : i + 1]))
                at, size = i + 1, 0
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return scored
