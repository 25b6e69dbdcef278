"""BPE encoding and decoding by a pair occurrence index.

All distinct pieces of a block lie end to end in one array of symbols. The index maps each pair that
some merge joins to the positions where it stands. Ranks that occur are taken in ascending order; all
positions of a rank are merged at once, and the pairs that a merge makes are added to the lists of
their own ranks. A merge can only make pairs of later ranks, since each symbol comes from one merge
and pairs that hold it were learned after it; the constructor checks this.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codelode.llm.common import as_text, prepare
from codelode.llm.pieces import blocks, byte_alphabet, worker_table


class PairIndexEncoder:
    """spec: a tokenizer file whose model is BPE over bytes, with or without an end-of-word suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain byte-level BPE model is needed")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank_of = np.full(self.size, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(made))).any():
            raise ValueError("merges must be in the order in which they were learned")
        self.left, self.right, self.made = left, right, made
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that no merge joins."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number per piece."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        n = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(n)
        sym = self.inner[data]
        filled = ends[n > 0] - 1
        sym[filled] = self.last[data[filled]]
        after = np.arange(1, len(sym) + 1)
        after[filled] = -1
        before = np.arange(-1, len(sym) - 1)
        before[(ends - n)[n > 0]] = -1
        self._merge(sym, after, before)
        live = sym >= 0
        kept = np.concatenate([[0], np.cumsum(live)])
        return sym[live].astype(np.int32), kept[ends] - kept[ends - n]

    def _merge(self, sym: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put positions on the lists of the pairs that begin there."""
            rank = self._rank(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        add(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right = self.left[rank], self.right[rank]
            at = at[(sym[at] == left) & (after[at] >= 0)]
            at = at[sym[after[at]] == right]
            if left == right and len(at) > 1:  # of overlapping pairs the first, third, ... are merged
                at = np.sort(at)
                starts = np.concatenate([[True], after[at[:-1]] != at[1:]])
                begin = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            sym[at] = self.made[rank]
            sym[gone] = -1
            after[at] = far
            before[far[far >= 0]] = at[far >= 0]
            prior = before[at]
            add(np.unique(np.concatenate([prior[prior >= 0], at[far >= 0]])))


class Decoder:
    """What the library's decode(ids, skip_special_tokens=False) gives for a file without a decoder:
    the ids' own strings, joined by spaces."""

    def __init__(self, spec: dict):
        if spec.get("decoder") is not None:
            raise ValueError("files that name a decoder are not handled")
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [""] * size
        for s, i in spec["model"]["vocab"].items():
            self.strings[i] = s
        for t in spec["added_tokens"]:
            self.strings[t["id"]] = t["content"]

    def __call__(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_DECODERS: dict[str, Decoder] = {}


def worker_decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        with open(path, encoding="utf-8") as f:
            _DECODERS[path] = Decoder(json.load(f))
    return _DECODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, one row per row of docs.

    Null and empty texts have no ids. Repeated rows are kept; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        table = worker_table(path, "pair_index")
        for part, texts in blocks(batches):
            ids, n = table.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return as_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of each row's ids; null ids give an empty text."""
    prepare(encoded.sparkSession)

    def run(batches):
        decoder = worker_decoder(path)
        for batch in batches:
            texts = [decoder(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """encode and decode in one pass over the texts: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The pair index is built over the pieces of a block that its worker meets for the first time; others have their ids already.

    One row per row of docs, whatever its other columns hold. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches):
        table, decoder = worker_table(path, "pair_index"), worker_decoder(path)
        numbers = [str(i) for i in range(len(decoder.strings))]
        for part, texts in blocks(batches):
            ids, n = table.encode(texts)
            ends = np.cumsum(n)
            of_ids, of_text = [], []
            for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
                own = ids[a:b].tolist()
                of_ids.append(hashlib.sha256(" ".join(map(numbers.__getitem__, own)).encode()).hexdigest())
                of_text.append(hashlib.sha256(decoder(own).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return as_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
