"""The Merkle manifest against a plain walk of the whole trees."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelode.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def reduced(nodes, fanout):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def expected(rows, now, fanout=3):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; now: the row as it is now."""
    groups = {}
    for row, other in zip(rows, now, strict=True):
        groups.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0), leaf(row), leaf(other), row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: reduced([x[1] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    top = reduced([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, (_, own, other, doc) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            node, proof = other, []
            for tree, at in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    a = at - at % fanout
                    left, right = level[a:at], level[at + 1 : a + fanout]
                    proof += left + right
                    node, at = h(*left, node, *right), at // fanout
            out.append((doc, own, trees[g][-1][0], top[-1][0], h(*proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def rows_of(rng, n, sources):
    out = [(rng.choice([None, *range(-3, 5 * n)]), rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", "é\n\n", "x" * 50])) for _ in range(n)]
    return out + out[: n // 5]


@pytest.mark.parametrize(("n", "sources", "digits", "fanout"), [(300, ["a", "b", None, "", "é", "aa", "Z"], None, 3), (90, ["a"], 1, 3), (150, ["a", None], 2, 2), (7, ["a", "b", "c", "d"], 1, 5), (1, [None], None, 3)])
def test_equals_the_walk(spark, n, sources, digits, fanout):
    rows = rows_of(random.Random(n), n, sources)
    now = [(*r[:4], None if r[4] is None else r[4].replace("\n", "")) for r in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, rank int").repartition(3)
    found = merkle.manifest(df, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, fanout=fanout, digits=digits)
    assert got(found) == expected(rows, now, fanout)
    for r in found.collect():
        assert merkle.folded(r.leaf, r.proof) == r.root and h(merkle.siblings(r.proof)) == r.proof_sha256


def test_ids_that_repeat_are_parted_by_leaf_and_place(spark):
    """A cell of more rows than a task may rank: one id with many texts, one with equal rows, rows without an id."""
    rows = [(7, "a", "en", 1, f"t{i}\n") for i in range(60)] + [(8, "a", "en", 1, "same")] * 70 + [(None, "a", "en", 1, f"n{i % 9}") for i in range(50)] + [(i, "a", None, None, None) for i in range(40)] + [(5000 * i, "b", None, None, "") for i in range(-20, 20)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(merkle.manifest(df, most=16)) == expected(rows, rows)


def test_far_ids_and_many_groups(spark):
    rows = [(x, f"https://host{i % 37}.example/", "en", i, "t") for i, x in enumerate([-(1 << 63), (1 << 63) - 1, 0, 1 << 40, -(1 << 40)] * 30)]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA), most=8)) == expected(rows, rows)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_leaf_from_another_group_or_place_does_not_verify(spark):
    rows = [(i, "ab"[i % 2], "en", 1, f"t{i}") for i in range(20)]
    found = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert merkle.folded(found[2].leaf, found[4].proof) != found[4].root and all(r.verified for r in found.values())


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(2, 4), st.integers(1, 3))
def test_pieces_give_the_same_tree(n, fanout, digits):
    nodes = [h(str(i)) for i in range(n)]
    whole = reduced(nodes, fanout)
    width, now = fanout**digits, nodes
    while len(now) > 1:
        parts = [now[i : i + width] for i in range(0, len(now), width)]
        now = [merkle.levels(p, fanout, merkle.depth_here(i, len(p), fanout, digits))[-1][0] for i, p in enumerate(parts)]
    assert now == whole[-1]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    now = [(*r[:4], r[4].replace("\n", "") if zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]) for r in rows]
    assert got(queries.op11_merkle(spark, sf)) == expected(rows, now)
