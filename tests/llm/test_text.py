"""BPE, token counts, packed ids and chat formatting, against the library and brute force."""

import hashlib
import json
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import bpe, chat, counts, packed, queries
from codelode.llm.pieces import LibraryPieces, PieceTable, Splitter

os.environ["TOKENIZERS_PARALLELISM"] = "false"
tokenizers = pytest.importorskip("tokenizers")
FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def both():
    out = {}
    for f in FILES:
        path = queries.tokenizer(f)
        with open(path, encoding="utf-8") as x:
            spec = json.load(x)
        out[f] = (tokenizers.Tokenizer.from_file(path), [PieceTable(Splitter(spec), e, 500) for e in (bpe.PairIndexEncoder(spec), LibraryPieces(spec))], bpe.Decoder(spec) if spec.get("decoder") is None else None)
    return out


ODD = ["", " ", "aaaa aaa", "don't 'S ''ll", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "a\n\n\n b", "ΑΣ σΣ", "İı ſ K Å", "ȩ́", "一二 〇", "👍🏽 ok", "½²٣", "\x1c\x1d\x85\xa0 ", "x" * 3000, "ab " * 2000]


@pytest.mark.parametrize("f", FILES)
def test_encoders_equal_the_library(both, f):
    lib, tables, decoder = both[f]
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aabé'\n <|>endoftx 12!*ßŒ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for t in tables:
        ids, n = t.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
        assert t.counts(texts).tolist() == [len(w) for w in want]
    if decoder:
        assert [decoder(w) for w in want] == [lib.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_encoders_on_any_text(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    path = queries.tokenizer(FILES[0])
    global LIB
    if "LIB" not in globals():
        with open(path, encoding="utf-8") as x:
            spec = json.load(x)
        LIB = (tokenizers.Tokenizer.from_file(path), PieceTable(Splitter(spec), bpe.PairIndexEncoder(spec)))
    ids, n = LIB[1].encode(texts)
    assert ids.tolist() == [i for t in texts for i in LIB[0].encode(t, add_special_tokens=False).ids] and len(n) == len(texts)


DOCS = "doc_id long, text string, ids string, n_tokens string"


def odd_docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(None, None, None, None), (3, None, None, None), (0, "again", None, None), (0, "again", None, None)]
    return spark.createDataFrame(rows, DOCS), [(r[0], r[1] or "") for r in rows]


def test_bpe_round_trip(spark, both):
    lib = both[FILES[0]][0]
    d, rows = odd_docs(spark)
    path = queries.tokenizer(FILES[0])
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = []
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted((tuple(r) for r in bpe.round_trip(d, path).collect()), key=key) == sorted(want, key=key)
    assert bpe.round_trip(d.limit(0), path).count() == 0
    one = bpe.encode(d.where("doc_id = 2"), path)
    assert one.first()["ids"] == lib.encode(ODD[2], add_special_tokens=False).ids
    assert bpe.decode(one, path).first()["text"] == lib.decode(one.first()["ids"], skip_special_tokens=False)


def test_counts_and_their_cache(spark, both, tmp_path):
    lib = both[FILES[0]][0]
    d, rows = odd_docs(spark)
    path, cache = queries.tokenizer(FILES[0]), f"{tmp_path}/cache"
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(i, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    want = sorted([(*w, w[2] > 1000) for w in want], key=key)
    for _ in range(2):
        assert sorted((tuple(r) for r in counts.count_tokens(d, path, cache, 1000).collect()), key=key) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second call encoded nothing
    before = stored.count()
    more = spark.createDataFrame([(1, "  don't 'S ''ll\n", "", ""), (2, "something new", "", "")], DOCS)
    assert sorted(r.n_tokens for r in counts.count_tokens(more, path, cache).collect()) == sorted(len(lib.encode(r.text, add_special_tokens=False).ids) for r in more.collect())
    assert spark.read.parquet(cache).count() == before + 1
    assert counts.count_tokens(d.limit(0), path, f"{tmp_path}/none").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24]), max_size=40))
def test_pack_round_trip(values):
    control, data = packed.pack(np.array(values, np.uint32))
    assert packed.unpack(control, data, len(values)).tolist() == values and len(control) == -(-len(values) // 4)


def test_packed_ids(spark, both, tmp_path):
    lib = both[FILES[1]][0]
    d, rows = odd_docs(spark)
    packed.write_ids(d, queries.tokenizer(FILES[1]), f"{tmp_path}/p", block_tokens=50)
    ids = sorted(((i, lib.encode(t, add_special_tokens=False).ids + [0]) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(packed.read_ids(spark, f"{tmp_path}/p").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in ids]
    assert sorted((r.doc_id or -1, r.ids) for r in got) == sorted((i or -1, x) for i, x in ids)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += len(r.ids)
    crc = {(r.start, r.ids_crc32) for r in packed.read_digests(spark, f"{tmp_path}/p").collect()}
    assert crc == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    ranks = spark.read.parquet(f"{tmp_path}/p/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True) and sum(r.n for r in ranks) == at
    packed.write_ids(d.limit(0), queries.tokenizer(FILES[1]), f"{tmp_path}/empty")
    assert packed.read_ids(spark, f"{tmp_path}/empty").count() == 0


def test_chat_folds_events(spark):
    e = [(1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, "assistant", "wr"), (1, 4, "delta", 1, None, "ong"), (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "ri"), (1, 7, "delta", 1, None, "ght"), (1, 8, "edit", 0, None, "hello"), (2, None, "message", None, None, None)]
    m = chat.fold(spark.createDataFrame(e, chat.EVENTS)).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in m] == [(1, 0, "user", "hello"), (1, 1, "assistant", "right"), (2, None, "", "")]
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(spark.createDataFrame([(1, 1, "shout", 0, "user", "hi")], chat.EVENTS)).collect()


def test_chat_reads_back(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "we\\ird\nro<|le", r"<\|im_end\\|> <| <\\| \\"), (2, 1, "assistant", None), (None, 0, "user", "é" * 5000), (3, None, None, "ends with <")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.as_events(d))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        learned = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)), len(learned), sha(learned))
    texts = {r.conv_id: r.formatted for r in chat.assemble(chat.format_conversations(chat.as_events(d))).collect()}
    assert {k: len(v) for k, v in texts.items()} == {k: r.formatted_chars for k, r in got.items()}
    assert chat.parse(texts[2]) == [("we\\ird\nro<|le", r"<\|im_end\\|> <| <\\| \\"), ("assistant", "")]
    assert texts[1].count("<|im_end|>") == 3
    with pytest.raises(ValueError):
        chat.parse("x" + texts[1])
    assert chat.read_back(chat.format_conversations(chat.as_events(d.limit(0)))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>a\n", max_size=20))
def test_escapes_are_reversible(t):
    import re

    escaped = re.sub(r"<(\\*)\|", lambda m: f"<{m[1]}\\|", t)
    assert "<|" not in escaped and chat.unescape_text(escaped) == t
    role = t.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")
    assert "\n" not in role and chat.unescape_role(role) == t


def test_queries_over_whole_tables(spark, sf, both):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lib = both[FILES[0]][0]
    ids = {k: lib.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    assert {r.doc_id: r.ids_sha256 for r in queries.QUERIES["op2_bpe"](spark, sf).collect()} == {k: sha(" ".join(map(str, v))) for k, v in ids.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.QUERIES["op4_token_counts"](spark, sf).collect()} == {k: (len(docs[k].encode()), len(v)) for k, v in ids.items()}
    lib = both[FILES[1]][0]
    at, want = 0, set()
    for k in sorted(docs):
        x = lib.encode(docs[k], add_special_tokens=False).ids + [0]
        want.add((k, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert {tuple(r) for r in queries.QUERIES["op9_packed_ids"](spark, sf).collect()} == want


def test_rows_of_one_id_fill_many_shards(spark, both, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "SHARD_IDS", 200)
    rows = [(7, f"word {i} of one document") for i in range(300)] + [(None, f"no id {i}") for i in range(100)] + [(i, "few") for i in range(5)] + [(7, "again")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed.write_ids(d, queries.tokenizer(FILES[1]), f"{tmp_path}/p", block_tokens=50)
    got = sorted(packed.read_ids(spark, f"{tmp_path}/p").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 100 + [0, 1, 2, 3, 4] + [7] * 340
    lib = both[FILES[1]][0]
    assert sorted(map(str, ((r.doc_id, r.ids) for r in got))) == sorted(map(str, ((i, lib.encode(t, add_special_tokens=False).ids + [0]) for i, t in rows)))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    shards = spark.read.parquet(f"{tmp_path}/p/blocks").where("exists(doc_ids, x -> x = 7)").select("shard").distinct().count()
    assert shards > 4


def brute_fold(events):
    """Messages by (conversation, turn, part), one event after another."""
    order = {k: i for i, k in enumerate(chat.KINDS)}
    out, part = {}, {}
    for conv, seq, kind, turn, role, text in sorted(events, key=lambda e: (e[0], e[3], e[1] is not None, e[1] or 0, order[e[2]], e[4] or "", e[5] or "")):
        if kind == "message":
            part[conv, turn] = part.get((conv, turn), 0) + 1
        key = (conv, turn, part.get((conv, turn), 0))
        m = out.setdefault(key, [role or "", ""])
        m[1] = m[1] + (text or "") if kind == "delta" else text or ""
    return {k: tuple(v) for k, v in out.items()}


def test_fold_equals_brute_force(spark):
    rng = random.Random(3)
    e = [(rng.randrange(3), rng.choice([None, *range(40)]), rng.choice(chat.KINDS), rng.randrange(4), rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "", None])) for _ in range(400)]
    got = {(r.conv_id, r.turn, r.part): (r.role, r.text) for r in chat.fold(spark.createDataFrame(e, chat.EVENTS)).collect()}
    assert got == brute_fold(e)


def test_conversations_become_logs_with_drafts_and_edits(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    log = chat.as_events(rows).cache()
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert kinds["message"] == rows.count() and kinds["edit"] > 0 and kinds["regenerate"] > 0 and kinds["delta"] >= 4 * rows.count()
    want = sorted((r.conv_id, r.turn, r.role, r.text) for r in rows.collect())
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(log).collect()) == want


def test_counts_of_a_tokenizer_that_keeps_white_space(spark, both, tmp_path):
    lib = both[FILES[1]][0]
    texts = ["word", " word", "word\n", "  word", "word\n\n"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(d, queries.tokenizer(FILES[1]), f"{tmp_path}/c").collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_logs_of_many_pieces_come_back_whole(spark):
    """Rows of one turn don't mix, however many deltas a row streams in."""
    rows = [(1, 0, "user", f"text number {i} " * (i + 3)) for i in range(8)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for pieces in (1, 4, 20, 100):
        got = sorted(r.text for r in chat.fold(chat.as_events(d, pieces)).collect())
        assert got == sorted(r[3] for r in rows), pieces
