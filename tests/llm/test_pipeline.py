"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import pytest

from codelode.llm import queries


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["toxicity", "quality", "near_dedup", "mix", "encode"]
    for _, d in stages[1:-1]:
        assert d.columns == stages[0][1].columns


def ids(d):
    return Counter(r[0] for r in d.select("doc_id").collect())


def test_decisions(spark, stages):
    s = dict(stages)
    kept = [ids(s[n]) for n in ("documents", "toxicity", "quality", "near_dedup", "mix", "encode")]
    assert all(a >= b for a, b in zip(kept[:4], kept[1:4], strict=False))
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    gone = kept[0] - kept[1]
    assert all(labels[k].toxic for k in gone if k in labels)
    left = [k for k in kept[1] if k in labels]
    assert sum(labels[k].toxic for k in left) < 0.05 * len(left)
    assert sum(1 for k in kept[1] - kept[2] if k in labels and labels[k].quality) <= 2
    assert max(kept[4].values()) <= 3 and set(kept[4]) <= set(kept[3]) and kept[5] == kept[4]
    texts = {r.doc_id: r.text for r in s["quality"].collect()}
    once = Counter(texts.values())
    survivors = Counter(texts[k] for k in kept[3])
    assert set(survivors) <= set(once) and max(survivors.values()) == 1
    whole = {r.doc_id: r.text for r in s["mix"].collect()}
    assert all(texts[k] == t for k, t in whole.items())


def test_near_copies(stages):
    s = dict(stages)
    shingles = lambda t: frozenset(zip(*[t.lower().split()[i:] for i in range(5)], strict=False)) or frozenset([tuple(t.lower().split())])
    before = {r.doc_id: shingles(r.text) for r in s["quality"].collect()}
    after = set(ids(s["near_dedup"]))
    near = lambda a, b, j: len(a & b) >= j * len(a | b)
    lone = [k for k in before if not any(x != k and near(before[k], before[x], 0.7) for x in before)]
    assert set(lone) <= after
    left = [k for k in after]
    assert not [1 for i, a in enumerate(left) for b in left[:i] if near(before[a], before[b], 0.87)]


def test_run(spark, sf):
    rows = queries.QUERIES["pipeline"](spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, queries.QUERIES["pipeline"](spark, sf).collect()))


def test_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None, None, None, 1), (1, None, None, None, 1), (None, "a b c", "en", "s", None), (2, "", "en", None, 2), (3, "word " * 20_000, None, "s", 3), (4, "word " * 20_000, None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        got = Counter(map(tuple, out.collect()))
        if name != "encode":
            assert out.columns == docs.columns and set(got) <= set(rows)
        want = {"toxicity": 6, "quality": 6, "near_dedup": 3, "encode": 6}
        assert name not in want or sum(got.values()) == want[name], name
    kept = {r.doc_id for r in dict(p.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()}
    assert kept == {None, 1, 3}


def test_rows_that_share_an_id_are_told_apart(spark, tmp_path):
    import corpus_pipeline as p

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "the first text of number one"), (1, "quite another text of number one"), (1, "the first text of number one"), (2, long), (3, long + " more"), (3, "clean words of number three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(map(tuple, dict(p.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()))
    assert kept == Counter([rows[0], rows[1], rows[3], rows[5]])


def test_near_dedup_equals_brute_force(stages, spark):
    s = dict(stages)
    shingles = lambda t: frozenset(zip(*[t.lower().split()[i:] for i in range(5)], strict=False)) or frozenset([tuple(t.lower().split())])
    before = {r.doc_id: shingles(r.text) for r in s["quality"].collect()}
    ids_ = sorted(before)
    of = {i: i for i in ids_}
    for n, i in enumerate(ids_):
        for j in ids_[:n]:
            if 10 * len(before[i] & before[j]) >= 8 * len(before[i] | before[j]):
                a, b = of[i], of[j]
                if a != b:
                    of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
    assert set(ids(s["near_dedup"])) == {i for i in ids_ if of[i] == i}
