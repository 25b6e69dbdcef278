"""The classifiers: held-out accuracy, and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import labelled, quality, queries, toxicity

SF1 = "/root/testdata/sf0.01"


def measured(spark, rows, label):
    got = rows.where("held_out").join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").select("score", "predicted", label).toPandas()
    pos, neg = (got[got[label] == k]["score"].to_numpy() for k in (1, 0))
    return (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2, (got["predicted"] == got[label]).mean()


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.9)])
def test_held_out(spark, sf, name, label, least):
    rows = queries.QUERIES[name](spark, SF1).cache()
    area, right = measured(spark, rows, label)
    assert area >= least and right >= 0.9
    assert rows.count() == spark.read.parquet(f"{SF1}/documents.parquet").count()
    assert rows.where("score < 0 or score > 1 or score is null").count() == 0
    again = queries.QUERIES[name](spark, SF1)
    assert rows.exceptAll(again).count() == 0


def small(spark):
    docs = [(i, ("you are a vile toad " if i % 2 else "what a lovely day ") * (1 + i % 3), "en") for i in range(60)]
    docs += [(100, None, None), (101, "", None), (102, "vile " * 30_000, None), (1, "you are a vile toad", None), (None, "vile toad", None)]
    labels = [(i, i % 2, 1 - i % 2) for i in range(60)] + [(100, 0, 1), (999, 1, 1), (None, 1, 1), (5, None, None), (101, 0, 0)]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, lang string, score string")
    return d, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_on_odd_rows(spark):
    d, labels = small(spark)
    scores = toxicity.score(d, toxicity.fit(d, labels))
    got = {r.doc_id: r.score for r in scores.collect()}
    assert scores.count() == d.count() and got[102] > 0.5 and got[1] > 0.5 and got[0] < 0.5 and got[100] == got[101] < 0.5
    none = toxicity.fit(d, labels.limit(0))
    assert {round(r.score, 9) for r in toxicity.score(d, none).collect()} == {0.25}
    assert toxicity.score(d.limit(0), none).count() == 0
    one = toxicity.fit(d, labels.where("toxic = 1"))
    assert min(r.score for r in toxicity.score(d, one).collect()) > 0.9
    m = toxicity.fit(d, labels)
    col = {r[0]: r[1] for r in d.where("doc_id is not null").select("doc_id", toxicity.score_of(m, spark)("text")).collect()}
    assert all(col[k] == pytest.approx(got[k]) for k in (0, 100, 102))


def test_quality_on_odd_rows(spark):
    d, labels = small(spark)
    d = d.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("### $$$ %%% "), "text")).otherwise(F.col("text")))
    m = quality.fit(d, labels)
    scores = quality.score(d, m)
    got = {r.doc_id: r.score for r in scores.collect()}
    assert scores.count() == d.count() and got[0] > got[1] and 0 < m.prior < 1
    assert {round(r.score, 3) for r in quality.score(d, quality.fit(d.limit(0), labels)).collect()} == {round(33 / 65, 3)}
    none = quality.fit(d, labels.limit(0))
    assert {r.score for r in quality.score(d, none).collect()} == {0.5}
    assert quality.score(d.limit(0), m).count() == 0
    col = {r[0]: r[1] for r in d.where("doc_id is not null").select("doc_id", quality.score_of(m, spark)("text")).collect()}
    assert col[100] == pytest.approx(got[100])


def test_hashed_ngrams_equal_brute_force():
    texts = ["Hello", "", "ab", "hellohello", "ÄÖ" * 20]
    found = [x.tolist() for x in toxicity.Present()(texts)]
    alone = [next(toxicity.Present()([t])).tolist() for t in texts]
    assert [sorted(x) for x in found] == [sorted(x) for x in alone] == [sorted(brute_grams(t)) for t in texts]
    assert set(found[0]) < set(found[3]) and not found[1] and not found[2]


def test_risk_is_never_negative_and_learns():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.3, (300, 2)), rng.normal(-1, 0.3, (100, 2))
    m = quality.fit_nnpu(good[:150], np.concatenate([good[150:], bad]), 0.6)
    assert m.score(good).mean() > 0.9 and m.score(bad).mean() < 0.5 and (m.score(good)[:, None] > m.score(bad)[None]).mean() > 0.99


def test_logistic_regression():
    rows, y = [np.array([0]), np.array([0]), np.array([1]), np.array([1])], np.array([1, 1, 0, 0])
    w, b = labelled.fit_logistic(rows, y, np.ones(2))
    assert w[0] + b > 1 and w[1] + b < -1


def test_logistic_regression_is_the_least():
    """The slope of loss and penalty is near zero, and no small step does better; also without features, and with equal rows."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(80)] + [np.zeros(0, np.int64)] * 3
    y, scale = (rng.random(83) < 0.4).astype(int), rng.normal(0, 1, 30)
    w, b = labelled.fit_logistic(rows, y, scale, 1e-2, 500, 1e-4)
    x = np.array([[scale[k] * (k in set(r)) for k in range(30)] for r in rows])
    off = labelled.sigmoid(x @ w + b) - y
    assert np.abs(x.T @ off / 83 + 1e-2 * w).max() < 1e-3 and abs(0.3 * off.mean() + 1e-2 * b / 0.3) < 1e-3
    assert labelled.calibrated(np.array([3.0, 5, -1, -4]), np.array([1, 1, 0, 0]))[0] > 0.9


def test_the_sample_counts_keys_not_rows(spark):
    d = spark.createDataFrame([(7, 1)] * 1990 + [(i, i) for i in range(100, 110)], "doc_id long, x long")
    assert {tuple(r) for r in labelled.lowest(d, 20, "doc_id").collect()} == {(7, 1), *((i, i) for i in range(100, 110))}
    assert labelled.lowest(d, 5, "doc_id").count() == 5
    every = spark.range(60_000).select(F.col("id").alias("doc_id"))
    order = [r[0] for r in every.orderBy(F.xxhash64("doc_id")).limit(50).collect()]
    assert [r[0] for r in labelled.lowest(every.unionAll(every), 50, "doc_id").collect()] == order


def test_quality_over_a_table_equals_the_fit_in_memory(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    m = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {k: quality.shape(t) for k, t in texts.items()}
    good = sorted(r.doc_id for r in labels.where("quality = 1").collect())
    own = quality.fit_nnpu(np.array([x[k] for k in good]), np.array(list(x.values())))
    assert np.allclose(m.edges, own.edges) and m.prior == pytest.approx(own.prior, abs=1e-9)
    assert np.allclose(m.score(np.array(list(x.values()))), own.score(np.array(list(x.values()))), atol=1e-6)
    share = labels.agg(F.avg("quality")).first()[0]
    assert abs(m.prior - share) < 0.08


def test_the_minimum_is_one(spark):
    """No small change of the weights lowers the non-negative risk."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.7, 0.6, (400, 3)), rng.normal(-0.7, 0.6, (150, 3))
    p, u = good[:200], np.concatenate([good[200:], bad])
    m = quality.fit_nnpu(p, u, 0.45)
    cp, cu = quality.coded(p, m.edges), quality.coded(u, m.edges)

    def risk(w):
        gp, gu = w[cp].sum(1) + w[-1], w[cu].sum(1) + w[-1]
        return 0.45 * np.logaddexp(0, -gp).mean() + max(0, np.logaddexp(0, gu).mean() - 0.45 * np.logaddexp(0, gp).mean()) + quality.PENALTY / 2 * w @ w

    w = np.append(m.weights.reshape(-1), m.intercept)
    assert all(risk(w + rng.normal(0, 0.01, len(w))) >= risk(w) - 1e-6 for _ in range(200))


def brute_grams(text):
    """Buckets of a text's n-grams, character by character."""
    t, out = [ord(c) for c in text.lower()], set()
    for n in toxicity.ORDERS:
        for i in range(len(t) - n + 1):
            h = 0
            for c in t[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c) % 2**64
            out.add(((h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n) % 2**64) >> (64 - toxicity.BITS))
    return out


def test_toxicity_equals_brute_force(spark):
    """Counts and ratios from sets of n-grams, all of them; the fit by its slope; probabilities from rows left out; scores word for word."""
    d, labels = small(spark)
    m = toxicity.fit(d, labels)
    label = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    by_id = {r.doc_id: brute_grams(r.text or "") for r in d.collect() if r.doc_id in label}
    ids = [r[0] for r in spark.createDataFrame([(i,) for i in by_id], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows, y = [by_id[i] for i in ids], np.array([label[i] for i in ids])

    def fitted(rows, y):
        n = {b: [sum(b in g for g, k in zip(rows, y, strict=True) if k == label) for label in (0, 1)] for b in set().union(*rows)}
        p, q = (sum(c[k] + 1 for c in n.values()) for k in (1, 0))
        ratio = {b: np.log((c[1] + 1) / p) - np.log((c[0] + 1) / q) for b, c in n.items()}
        sure = {b: ratio[b] ** 2 / (1 / (c[1] + 1) + 1 / (c[0] + 1)) for b, c in n.items()}
        ratio = {b: r * sure[b] / (sure[b] + toxicity.CERTAIN) for b, r in ratio.items()}
        weights, b = toxicity.fit_scaled([np.array(sorted(g), np.int64) for g in rows], y)
        names = sorted(ratio)
        scale = np.array([ratio[x] for x in names])
        w = np.divide(weights[names], scale, out=np.zeros_like(scale), where=scale != 0)
        x = np.array([[ratio[k] * (k in g) for k in names] for g in rows])
        off = labelled.sigmoid(x @ w + b) - y
        assert np.abs(x.T @ off / len(y) + 1e-3 * w).max() < 2e-2 and not weights[[k for k in range(0, 1 << toxicity.BITS, 997) if k not in ratio]].any()
        return weights, b

    weights, b = fitted(rows, y)
    order = np.argsort(y, kind="stable")
    margins, seen = np.zeros(len(y)), []
    for k in range(toxicity.PARTS):
        out = order[k :: toxicity.PARTS].tolist()
        rest = [i for i in range(len(y)) if i not in set(out)]
        w, c = fitted([rows[i] for i in rest], y[rest])
        margins[out] = [sum(w[g] for g in sorted(rows[i])) + c for i in out]
        seen += out
    slope, shift = labelled.calibrated(margins, y)
    got = {r.doc_id: r.score for r in toxicity.score(d, m).collect() if r.doc_id is not None}
    for r in d.where("doc_id > 1").collect():
        want = slope * (b + sum(weights[g] for g in brute_grams(r.text or ""))) + shift
        assert got[r.doc_id] == pytest.approx(labelled.sigmoid(np.array(want)), abs=1e-6)


def test_a_few_labelled_rows_are_enough(spark):
    """Two rows of each kind give a model; one of each still ranks what it has seen."""
    d = spark.createDataFrame([(1, "you vile idiot"), (2, "what a vile idiot you are"), (3, "a quiet walk"), (4, "quiet rain on a walk"), (5, "vile idiot"), (6, "quiet walk")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    for some in (labels, labels.where("doc_id in (1, 3)")):
        got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, some)).collect()}
        assert got[5] > got[6] + 1e-3 and got[1] > got[3] + 1e-3 and len({round(x, 6) for x in got.values()}) > 3, got


def test_the_bound_of_entries_takes_rows_in_order(spark, monkeypatch):
    d, labels = small(spark)
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 300)
    m = toxicity.fit(d, labels)
    assert 0 < np.count_nonzero(m.weights) <= 300


def test_features_reach_the_driver_packed():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3000):
        own = rng.permutation(1 << toxicity.BITS)[:n].astype(np.int32)
        data = toxicity.packed(own)
        assert np.array_equal(toxicity.unpacked(data), np.sort(own)) and len(data) <= max(16, 2 * n)  # four bytes a number before
