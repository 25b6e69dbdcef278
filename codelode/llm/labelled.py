"""What the classifiers share: bounded samples of labelled rows, and logistic regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; of more, those with the smallest hash of doc_id.
MOST_LABELLED = 20_000


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo: which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def lowest(df: DataFrame, most: int, *key: str) -> DataFrame:
    """At most so many rows of df, one per key: those with the smallest hash of the first key column, ties by key.

    Other columns are the least of a key's rows. Hashes above what so many distinct first keys can be expected to
    need (half as many again) are left out first, so that tasks don't each send as many rows; should too few be
    left, twice the share is tried, up to all.
    """
    h = F.xxhash64(key[0])
    rest = [F.min(c).alias(c) for c in df.columns if c not in key]
    one = lambda d: d.groupBy(*key).agg(*rest) if rest else d.select(*key).distinct()
    share = 1.5 * most / max(df.agg(F.approx_count_distinct(key[0], 0.02)).first()[0], 1)
    while share < 1:
        part = one(df.where(h < int(-(2**63) + share * 2**64)))
        if part.count() >= most:
            return part.select(*df.columns).orderBy(h, *key).limit(most)
        share *= 2
    return one(df).select(*df.columns).orderBy(h, *key).limit(most)


def sample(labels: DataFrame, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """At most so many rows (doc_id, label 0 or 1) of labels; rows with a null in either don't count.

    Its size is bounded by most, so it may be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = lowest(known, most, "doc_id", "label").collect()
    return labels.sparkSession.createDataFrame([tuple(r) for r in rows], "doc_id long, label int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float = 1e-3, passes: int = 10, near: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on rows of binary features, each multiplied by its scale.

    Least is mean log loss plus penalty / 2 times the squares of the weights (of the intercept too, as of a feature of scale
    0.3). Found by steps on the dual, row by row: a step solves for one row's own weight by Newton's method, so it costs
    the features of a row, however many features there are. Passes go over the rows in an order drawn from a
    fixed seed, until no row's slope is over near. Reruns agree.
    """
    n, one = len(rows), 0.3
    sign = np.where(np.asarray(y) > 0, 1.0, -1.0).tolist()
    most = 1 / (penalty * max(n, 1))
    square = [float((scale[r] ** 2).sum()) + one**2 for r in rows]
    own = [most * 1e-3] * n
    w, b = np.zeros(len(scale)), 0.0
    for r, a, s in zip(rows, own, sign, strict=True):
        w[r] += a * s * scale[r]
        b += a * s * one
    rng = np.random.default_rng(0)
    for _ in range(passes):
        steepest = 0.0
        for i in rng.permutation(n).tolist():
            r, s, q, was = rows[i], sign[i], square[i], own[i]
            v = scale[r]  # not kept, which would take more memory than the rows
            margin = s * (float(w[r] @ v) + b * one)
            # the least of q / 2 (x - was)^2 + margin (x - was) + x log x + (most - x) log(most - x) over 0 < x < most
            x = was
            for step in range(50):
                slope = q * (x - was) + margin + math.log(x / (most - x))
                if step == 0:
                    steepest = max(steepest, abs(slope) * min(was, most - was) / most)
                if abs(slope) < near / 50:
                    break
                to = x - slope / (q + most / (x * (most - x)))
                x = to if 0 < to < most else x / 10 if to <= 0 else most - (most - x) / 10
                x = min(max(x, most * 1e-13), most * (1 - 1e-13))
            if x != was:
                w[r] += (x - was) * s * v
                b += (x - was) * s * one
                own[i] = x
        if steepest < near:
            break
    return w, b * one


#: How many rows' worth the slope and intercept of a calibration hold on to 1 and 0.
FIRM = 10.0


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into log odds: of least log loss plus FIRM / 2 times the squares of how far they are from 1 and 0, so that few rows change little."""
    x, a = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    loss = lambda a: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ a)).sum() + FIRM * ((a - [1, 0]) ** 2).sum() / 2
    for _ in range(50):
        p = sigmoid(x @ a)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + FIRM * np.eye(2), x.T @ (p - y) + FIRM * (a - [1, 0]))
        size = 1.0
        while size > 1e-6 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])
