"""Licence notices against a scan of all places of all templates."""

import math
import random
import re

import pytest

from codelode.llm import licences, queries
from codelode.llm.licences import BASE, TEMPLATES, Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(UPPER))


def weights(texts, templates):
    sets = [set(split(t)) for t in texts]
    words = {w for t in (*templates, *BASE) for w in split(t.text)}
    return {w: 1 + math.floor(1000 * math.log((len(texts) + 1) / (sum(w in s for s in sets) + 1))) for w in words}


def brute(text, templates, weight, share=licences.SHARE, slack=licences.SLACK):
    """n_words, base places, {label: best share} of every notice."""
    words = split(text)
    stands = lambda phrase, i: i >= 0 and words[i : i + len(phrase)] == phrase
    base = sorted((t.label, i) for t in BASE for i in range(len(words)) if stands(split(t.text), i))
    notices = {}
    for t in templates:
        own = split(t.text)
        total = sum(weight[w] for w in own)
        for o in range(-len(own) - slack, len(words) + slack):
            got = sum(weight[w] for j, w in enumerate(own) if w in words[max(o + j - slack, 0) : max(o + j + slack + 1, 0)])
            if got < share * total:
                continue
            if all(any(stands(p, i) for i in range(o + k - slack, o + k + slack + 1)) for p in map(split, t.phrases) for k in [next(k for k in range(len(own)) if own[k : k + len(p)] == p)]):
                notices[t.label] = max(notices.get(t.label, 0), got / total)
    return len(words), base, notices


def edited(rng, text):
    words = text.split()
    for _ in range(rng.randrange(5)):
        i = rng.randrange(len(words) + 1)
        words[i : i + rng.randrange(3)] = rng.choice([[], ["the"], ["ünd"], ["license"], ["x", "y"]])
    return rng.choice([" ", "\n", ", "]).join(words)


def made(rng):
    prose = lambda: " ".join(rng.choice(["the", "of", "a", "license", "under", "mit", "cc", "by", "software", "ñandu", "and", "gnu", "2", "0"]) for _ in range(rng.randrange(40)))
    return " ".join([prose(), *(edited(rng, rng.choice([*TEMPLATES, *BASE]).text) + ". " + prose() for _ in range(rng.randrange(4)))])


def labels(found):
    return {x.label: max(y.share for y in found if y.label == x.label) for x in found}


@pytest.mark.parametrize(("share", "slack"), [(licences.SHARE, licences.SLACK), (0.3, 0), (1.0, 5)])
def test_equals_the_scan_of_all_places(spark, share, slack):
    rng = random.Random(3)
    texts = [made(rng) for _ in range(250)] + ["", None, "MIT LICENSE", "mit İ license", "GNU  general\npublic (license)", "mit license mit license", "apache licensé", "CC BY-NC 4.0"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "mit license", None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, notices string, n_words int").repartition(3)
    by = licences.index(df, share=share, slack=slack)
    weight = weights([r[1] for r in rows], TEMPLATES)
    assert {w.decode(): n for w, n in by.weight.items()} == weight
    got = {r.doc_id: r for r in licences.scan(df, by).collect()}
    found = 0
    for i, t, *_ in rows:
        n, base, notices = brute(t, TEMPLATES, weight, share, slack)
        assert (got[i].n_words, sorted(map(tuple, got[i].base))) == (n, base), t
        assert labels(got[i].notices) == pytest.approx(notices), t
        found += len(notices)
    assert found > 50
    assert licences.scan(df, by).count() == len(rows)


def test_rare_words_are_enough():
    """No text without a template's rare words can hold its notice."""
    for t in TEMPLATES:
        rng = random.Random(t.text)
        weight = {w: rng.randint(1, 9000) for w in t.words}
        by = licences.Index((t,), weight, 0.6, 3)
        rare = by.rare(t)
        assert sum(weight[w] for w in t.words if w not in rare) < by.least(t)
        rest = sorted(rare, key=lambda w: (weight[w], w))[1:]  # and none of them is one too many
        assert sum(weight[w] for w in t.words if w not in rest) >= by.least(t)


def test_templates_of_ones_own_and_empty_tables(spark):
    own = (Template("house", "All rights reserved by the house of codes", ("rights reserved",)),)
    df = spark.createDataFrame([(1, "x All rights, reserved by the house of Codes"), (2, "rights of the house")], "doc_id long, text string")
    by = licences.index(df, own)
    assert [[x.label for x in r.notices] for r in licences.scan(df, by).orderBy("doc_id").collect()] == [["house"], []]
    none = df.where("doc_id > 5")
    assert licences.scan(none, licences.index(none)).collect() == []


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    weight = weights(list(docs.values()), TEMPLATES)
    rows = queries.op13_licences(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        if not {"license", "cc", "licensed", "gnu"} & set(split(docs[r.doc_id])):
            assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (0, None, None, "")
            continue
        n, base, notices = brute(docs[r.doc_id], TEMPLATES, weight)
        at = [i for _, i in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in base})) and r.labels == ",".join(sorted({x for x, _ in base} | set(notices)))
        assert r.score == (1.0 if base else pytest.approx(max(notices.values(), default=0)))
