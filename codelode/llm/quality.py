"""A quality classifier learned from positives and unlabelled text.

Texts are described by numbers of their shape (kinds of characters, lengths and repetition of words),
each cut into ranges that hold equal shares of all documents. A linear model over the ranges minimises
the non-negative unbiased risk: with g the model, l the logistic loss and pi the share of good texts,
pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]). Positives are trusted labels, unlabelled texts are all
documents: each step of Newton's method is one pass over their ranges, a byte each. Sums are whole numbers
(shares of 2^-20), so they don't depend on the order of tasks, and reruns agree.

The class prior pi is estimated from the same two: a naive Bayes score, learned from half of the positives, ranks
texts; where it is high unlabelled texts are nearly all good, so that the share of all texts above a threshold,
divided by that of the other half, is near pi. The threshold is the one with the least upper bound.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import as_text, prepare
from codelode.llm.labelled import MOST_LABELLED, sample, sigmoid
from codelode.llm.pieces import blocks

#: Ranges of a number, steps of Newton's method, halvings of the factor, penalty of weights, parts of one in sums, and
#: thresholds tried for the prior.
BINS, STEPS, HALVINGS, PENALTY, PARTS, THRESHOLDS = 16, 30, 7, 0.008, 1 << 20, 200
CHARS = 2_000_000
SHAPE = ("log_words", "word_length", "upper", "digits", "marks", "runs_of_marks", "bars", "shouts", "stops", "distinct", "commonest", "adjacent", "short", "lines")


def shape(text: str) -> list[float]:
    """The numbers named in SHAPE, over the whole text; all zero for a text without words."""
    w = text.split()
    if not w:
        return [0.0] * len(SHAPE)
    n, chars = len(w), sum(map(len, w))
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = np.bincount(c[c < 128], minlength=128)
    letters = ascii_[65:91].sum() + ascii_[97:123].sum() + int((c >= 128).sum())
    marks = ascii_[33:127].sum() - ascii_[48:58].sum() - ascii_[65:91].sum() - ascii_[97:123].sum()
    mark = np.zeros(128, bool)
    mark[33:127] = True
    mark[48:58] = mark[65:91] = mark[97:123] = False
    is_mark = mark[np.minimum(c, 127)] & (c < 127)
    runs = int((is_mark[:-2] & is_mark[1:-1] & is_mark[2:]).sum()) if len(c) > 2 else 0
    seen = Counter(w)
    same = sum(map(str.__eq__, w, w[1:]))
    short = sum(1 for x in w if len(x) <= 3)
    return [
        float(np.log1p(n)), chars / n, ascii_[65:91].sum() / max(letters, 1), ascii_[48:58].sum() / chars, marks / chars, runs / n, ascii_[124] / n, ascii_[33] / n,
        (ascii_[46] + ascii_[44]) / n, len(seen) / n, seen.most_common(1)[0][1] / n, same / n, short / n, ascii_[10] / n,
    ]


@dataclass
class Model:
    """edges: the cuts of each number (columns). weights: by number and range."""

    edges: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.full(len(x), self.intercept)
        for i in range(x.shape[1]):
            g += self.weights[i][np.searchsorted(self.edges[:, i], x[:, i], side="right")]
        return sigmoid(g)


def cells(x: np.ndarray) -> np.ndarray:
    """The leading bits of numbers, down to a 256th of their power of two, as whole numbers in the same order."""
    return np.ascontiguousarray(x, np.float64).view(np.int64) >> 44


def edges_of(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """From each number's cells, ascending, and how many texts are in each: the cuts between ranges of equal shares, at ends of cells."""
    out = []
    for own, n in found:
        upto = np.cumsum(n)
        at = np.searchsorted(upto, np.ceil(upto[-1] * np.arange(1, BINS) / BINS))
        out.append((own[at].astype(np.int64) << 44).view(np.float64))
    return np.array(out).T


def coded(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The range of each number (columns), counted through all of them."""
    return np.stack([np.searchsorted(edges[:, i], x[:, i], side="right") + i * BINS for i in range(edges.shape[1])], 1) if len(x) else np.zeros((0, edges.shape[1]), np.int64)


def sums(code: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Over rows: the loss of taking them for good, its slope and its curvature by weight, in parts of one."""
    loss, slope, curve = 0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for i in range(0, len(code), 4096):
        own = code[i : i + 4096]
        one = np.zeros((len(own), len(w)))
        one[np.arange(len(own))[:, None], own] = 1
        one[:, -1] = 1
        g = w[own].sum(1) + w[-1]
        p = sigmoid(g)
        loss += int(np.rint(np.logaddexp(0, g) * PARTS).sum())
        slope += np.rint(p * PARTS) @ one
        curve += one.T @ (np.rint(p * (1 - p) * PARTS)[:, None] * one)
    return loss, slope, curve


def minimised(over_all, n: int, positive: np.ndarray, k: int, prior: float) -> np.ndarray:
    """Weights, the last being the intercept, from the codes of positives and over_all(w), which gives sums() of all n texts.

    At the minimum of the clipped risk either the risk of the negatives isn't below zero, or it is zero and counts by a
    factor below one, the slope of the clipping there. For a given factor the risk is convex; the factor is found by halving.
    """
    one = np.zeros((len(positive), k * BINS + 1))
    one[np.arange(len(positive))[:, None], positive] = 1
    one[:, -1] = 1
    ones = one.mean(0)

    def lowest_risk(factor: float, w: np.ndarray) -> tuple[np.ndarray, float]:
        best, least, negative, halved, own = w, np.inf, 0.0, 0, prior * (1 - factor)
        for _ in range(STEPS):
            loss, slope, curve = over_all(w)
            g = one @ w
            p = sigmoid(g)
            # with the logistic loss l(g) - l(-g) = -g, so that part of the positives counts by the mean of their ranges
            risk = factor * (loss / PARTS / n - prior * ones @ w) + own * np.logaddexp(0, -g).mean() + PENALTY / 2 * w @ w
            if risk > least + 1e-9:  # a step too far
                if halved == 5:
                    break
                w, halved = (w + best) / 2, halved + 1
                continue
            best, least, halved = w, risk, 0
            negative = loss / PARTS / n - prior * np.logaddexp(0, g).mean()
            down = factor * (slope / PARTS / n - prior * ones) + own * one.T @ (p - 1) / len(one) + PENALTY * w
            if np.abs(down).max() < 1e-4:
                break
            bend = factor * curve / PARTS / n + own * one.T @ ((p * (1 - p))[:, None] * one) / len(one)
            w = w - np.linalg.solve(bend + PENALTY * np.eye(len(w)), down)
        return best, negative

    w, negative = lowest_risk(1.0, np.zeros(k * BINS + 1))
    if negative >= 0:
        return w
    low, high, kept = 0.0, 1.0, w
    for _ in range(HALVINGS):
        w, negative = lowest_risk((low + high) / 2, w)
        if negative >= 0:
            low, kept = (low + high) / 2, w
            if negative < 0.002:
                break
        else:
            high = (low + high) / 2
    return kept


def ranked(positive: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each half of the positives, a naive Bayes score by range that is learned from the other half (log ratios of
    smoothed shares in positives and in all texts), the half's own scores, and thresholds among them."""
    out = []
    for i in (0, 1):
        fit, own = (positive[i::2], positive[1 - i :: 2]) if len(positive) > 1 else (positive, positive)
        p, q = np.bincount(fit.reshape(-1), minlength=len(counts)) + 1.0, counts + 1.0
        v = np.log(p / p.sum()) - np.log(q / q.sum())
        scores = v[own].sum(1)
        out.append((v, scores, np.unique(np.quantile(scores, np.arange(THRESHOLDS) / THRESHOLDS, method="inverted_cdf"))))
    return out


def above(code: np.ndarray, halves: list) -> np.ndarray:
    """How many rows reach each threshold of each half, end to end."""
    return np.concatenate([(v[code].sum(1)[:, None] >= t).sum(0) for v, _, t in halves])


def prior_of(halves: list, reached: np.ndarray, n: int) -> float:
    """The prior from how many of all n texts reach the thresholds: the mean over halves, each less a deviation."""
    out, at = [], 0
    for _, scores, thresholds in halves:
        share, of_all = (scores[:, None] >= thresholds).mean(0), reached[at : at + len(thresholds)] / n
        at += len(thresholds)
        slack = np.sqrt(np.log(40) / 2) * (n**-0.5 + len(scores) ** -0.5)
        best = np.argmin((of_all + 1.01 * slack) / share)
        p, u = share[best], of_all[best]
        out.append(u / p - np.sqrt(max(u * (1 - u), 0) / n + (u / p) ** 2 * p * (1 - p) / len(scores)) / p)
    return float(np.clip(np.mean(out), 0.01, 0.99))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The model for numbers in memory; fit() does the same over a table. Without a prior it is estimated."""
    k = unlabelled.shape[1]
    edges = edges_of([np.unique(c, return_counts=True) for c in cells(unlabelled).T])
    cp, cu = coded(positive, edges), coded(unlabelled, edges)
    if prior is None:
        halves = ranked(cp, np.bincount(cu.reshape(-1), minlength=k * BINS))
        prior = prior_of(halves, above(cu, halves), len(cu))
    w = minimised(lambda x: sums(cu, x), len(cu), cp, k, prior)
    return Model(edges, w[:-1].reshape(k, BINS), float(w[-1]), prior)


def shapes(df: DataFrame, key: str) -> DataFrame:
    """key and x, the numbers of SHAPE, for each row of df (key, text)."""

    def run(batches):
        for part, texts in blocks(batches, chars=CHARS):
            x = np.array([shape(t) for t in texts]).reshape(-1, len(SHAPE))
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(SHAPE)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], [key, "x"])

    return df.select(key, "text").mapInArrow(run, f"{key} long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model for labels (doc_id, quality) of docs (doc_id, text); see fit_shapes."""
    prepare(docs.sparkSession)
    return fit_shapes(shapes(as_text(docs), "doc_id").checkpoint(), labels, most)


def fit_shapes(shaped: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model for labels (doc_id, quality) of shaped (doc_id, x), which holds all documents.

    Positives are at most so many labels of 1, one row for each id; labels of 0 aren't examples. Without positives or
    documents every score is the share of good labels, 0.5 if there are none.
    """
    known = sample(labels, "quality", most)
    good, n_labels = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    # at most so many rows
    own = shaped.join(F.broadcast(known.where("label = 1")), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    x = np.array([r["x"] for r in sorted(own)]).reshape(-1, len(SHAPE))
    k = len(SHAPE)
    n = shaped.count()
    if not len(x) or not n:
        share = (good + 1) / (n_labels + 2)
        return Model(np.zeros((BINS - 1, k)), np.zeros((k, BINS)), float(np.log(share / (1 - share))), share)

    def by_cell(x):
        found = [np.unique(c, return_counts=True) for c in cells(x).T]
        return [(i, int(c), int(m)) for i, (own, m) in enumerate(found) for c, m in zip(own, m, strict=True)]

    # counts by cell, of which numbers have some thousands
    met = sorted((r["i"], r["j"], r["v"]) for r in _totals(shaped.select("x"), by_cell, _numbers))
    met = np.array(met, np.int64)
    edges = edges_of([(met[met[:, 0] == i, 1], met[met[:, 0] == i, 2]) for i in range(k)])
    codes = _codes(shaped, edges).checkpoint()
    positive = coded(x, edges)

    count = np.zeros(k * BINS, np.int64)
    for r in _totals(codes, lambda c: [(i, 0, n) for i, n in enumerate(np.bincount(c.reshape(-1), minlength=k * BINS).tolist()) if n]):
        count[r["i"]] = r["v"]
    halves = ranked(positive, count)
    reached = np.zeros(sum(len(t) for _, _, t in halves), np.int64)
    for r in _totals(codes, lambda c: [(i, 0, n) for i, n in enumerate(above(c, halves).tolist())]):
        reached[r["i"]] = r["v"]
    prior = prior_of(halves, reached, n)

    def over_all(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def rows(c):
            loss, slope, curve = sums(c, w)
            i, j = np.nonzero(np.triu(curve))
            return [(-1, 0, loss), *((a, -1, int(s)) for a, s in enumerate(slope)), *zip(i.tolist(), j.tolist(), curve[i, j].astype(np.int64).tolist(), strict=True)]

        loss, slope, curve = 0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for r in _totals(codes, rows):  # as many rows as the curvature has entries
            if r["i"] < 0:
                loss = r["v"]
            elif r["j"] < 0:
                slope[r["i"]] = r["v"]
            else:
                curve[r["i"], r["j"]] = curve[r["j"], r["i"]] = r["v"]
        return loss, slope, curve

    w = minimised(over_all, n, positive, k, prior)
    return Model(edges, w[:-1].reshape(k, BINS), float(w[-1]), prior)


def _codes(shaped: DataFrame, edges: np.ndarray) -> DataFrame:
    """The ranges of each row's numbers, a byte each."""

    def run(batches):
        for batch in batches:
            c = coded(_numbers(batch.column(0)), edges).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in c], pa.binary())], ["codes"])

    return shaped.select("x").mapInArrow(run, "codes binary")


def _of_codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, len(SHAPE)).astype(np.int64)


def _totals(table: DataFrame, rows, of=_of_codes) -> list:
    """Sums by i and j of the numbers v that rows, a function of what of makes of the one column, gives for each batch."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for i, j, v in rows(of(batch.column(0))):
                total[i, j] += v
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in total], pa.int32()), pa.array([x[1] for x in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["i", "j", "v"])

    return table.mapInArrow(run, "i int, j int, v long").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(SHAPE))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, one row per row of docs; null texts count as empty."""
    prepare(docs.sparkSession)
    return score_shapes(shapes(as_text(docs), "doc_id"), model)


def score_shapes(shaped: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of rows (doc_id, x)."""
    shared = shaped.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_numbers(batch.column(1))))], ["doc_id", "score"])

    return shaped.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score_of(model: Model, spark):
    """The score as a column function of a text column."""
    shared = prepare(spark).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([shape(t) for t in text.fillna("")]).reshape(-1, len(SHAPE))))

    return scored
