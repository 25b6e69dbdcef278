"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, shortest=12):
    """Every maximal stretch of each period, least period first."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= shortest:
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, e - a, q) for (a, e), q in found.items()), key=lambda r: (r[0], r[2]))


def dropped(n, runs):
    return [i for i in range(n) if any(a + q <= i < a + length for a, length, q in runs)]


def made(rng):
    """A text that is rich in repeats: random words, powers, powers of powers, Fibonacci-like growth, far copies."""
    kind, alphabet = rng.randrange(5), rng.choice([1, 2, 3, 8, 200])
    part = lambda n: [rng.randrange(alphabet) for _ in range(n)]
    if kind == 0:
        return part(rng.randrange(120))
    if kind == 1:
        return part(rng.randrange(9)) + (part(rng.randint(1, 30)) * rng.randint(1, 9))[: rng.randrange(200)] + part(rng.randrange(9))
    if kind == 2:
        inner = part(rng.randint(1, 4)) * rng.randint(2, 6) + part(rng.randrange(4))
        return inner * rng.randint(2, 5) + part(3) + inner
    if kind == 3:
        a, b = part(rng.randint(1, 3)), part(rng.randint(1, 3))
        while len(b) < rng.randint(20, 250):
            a, b = b, b + a
        return b
    far = part(rng.randint(3, 25))
    return sum(([*far, *part(rng.randrange(12))] for _ in range(rng.randint(2, 7))), [])


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = made(rng)
        want = brute(words)
        assert periodic.runs_of(np.array(words, np.int64)) == want
        text = b" ".join(b"w%d" % w for w in words)
        (runs, left), = periodic.searched([text])
        assert runs == want
        assert left.split() == [b"w%d" % w for i, w in enumerate(words) if i not in set(dropped(len(words), want))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(2, 14))
def test_any_words_and_lengths(words, shortest):
    assert periodic.runs_of(np.array(words, np.int64), shortest) == brute(words, shortest)
    (runs, _), = periodic.searched([b" ".join(b"%d" % w for w in words)], shortest)
    assert runs == brute(words, shortest)


def test_texts_that_are_looked_at_together_do_not_mix():
    rng = random.Random(9)
    texts = [[f"w{x}" for x in made(rng)] for _ in range(300)]
    texts[5] = texts[6] = ["a", "b"] * 3  # 12 words only if taken as one
    got = list(periodic.searched([" ".join(t).encode() for t in texts]))
    assert [r for r, _ in got] == [brute(t) for t in texts]


@pytest.mark.parametrize("words", [["x"] * 200_000, ["a", "b", "c"] * 50_000, [str(i) for i in range(70_000)] * 2, [str(i % 5000) for i in range(150_000)]])
def test_long_texts(words):
    n = len(words)
    (runs, left), = periodic.searched([" ".join(words).encode()])
    q = next(i for i in range(1, n) if words[i] == words[0])
    assert runs == [(0, n, q)] and left == " ".join(words[:q]).encode()


def test_table(spark):
    texts = ["", None, "a", "a " * 12, " a\tb\n" * 6 + "\x0b", "a\xa0a " * 12, "x " * 11, "ü ö " * 9 + "end", "a " * 12]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "b " * 30, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int").repartition(3)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.text) for r in periodic.find_runs(df).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        runs = brute(words)
        gone = set(dropped(len(words), runs))
        want.append((i, runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic.find_runs(df.where("1 = 0")).collect() == []


def planted(doc, text):
    words, h = WORD.findall(text), zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_periodic(spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        words = planted(r.doc_id, docs[r.doc_id])
        runs = brute(words) if len(words) < 1500 else None
        if runs is None:
            continue
        gone = set(dropped(len(words), runs))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * r.length // r.period if runs else None)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
