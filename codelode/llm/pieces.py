"""Pre-tokenisation, and a table of the distinct pieces that a worker has met.

A tokenizer of the kind handled here cuts a text at special strings, normalises what is left, splits
it into pieces by a pattern and encodes each piece by itself. Natural text repeats its pieces, so a
worker encodes each distinct piece once and turns a block of texts into ids by numpy gathers.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps at most; the table starts anew beyond it (results don't change).
MAX_PIECES = 700_000
#: Characters of text per block.
BLOCK_CHARS = 6_000_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


#: Ranges of characters of the scripts for which Python's tables and the library's are known to agree.
#: Texts that hold any other are normalised and split by the library itself.
USUAL = "\x00-\u012f\u0131-\u017f\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3008-\u3020\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f"
UNUSUAL = re.compile(f"[^{USUAL}]")
WHITE = "\t-\r \x85\xa0"


@functools.cache
def usual(kind: str) -> str:
    """Ranges of the usual letters (L), numbers (N) or other characters that aren't white space (O)."""
    def of(c: str) -> str:
        return k if (k := unicodedata.category(c)[0]) in "LN" else "S" if re.match(f"[{WHITE}]", c) else "O"

    codes = [c for a, z in re.findall("(.)-(.)", USUAL, re.S) for c in range(ord(a), ord(z) + 1) if of(chr(c)) == kind]
    out, at = [], 0
    for i, c in enumerate(codes):
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{codes[at]:08x}-\\U{c:08x}")
            at = i + 1
    return "".join(out)


def usual_pattern(source: str) -> re.Pattern:
    """A tokenizer's pattern for texts of usual characters only, with classes spelled out."""
    names = ((r"[^\s\p{L}\p{N}]", "<O>"), (r"[\p{L}]", "<L>"), (r"[\p{N}]", "<N>"), (r"\p{L}", "<L>"), (r"\p{N}", "<N>"), (r"\s", "<S>"), (r"\S", "<T>"))
    for old, new in names:
        source = source.replace(old, new)
    parts = source.split("|")
    if re.search(r"\\p|\\[sSwW]|\[", source):
        raise ValueError(f"pattern not supported: {source}")
    # alternatives that begin with a letter or a blank come first: the most frequent, and no other begins so
    parts = [p for p in parts if "<L>" in p] + [p for p in parts if "<L>" not in p]
    classes = {"L": f"[{usual('L')}]", "N": f"[{usual('N')}]", "O": f"[{usual('O')}]", "S": f"[{WHITE}]", "T": f"[^{WHITE}]"}
    return re.compile(re.sub("<(.)>", lambda m: classes[m[1]], "|".join(parts)))


class Splitter:
    """The special strings, normaliser and pattern of a tokenizer file."""

    def __init__(self, spec: dict):
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        steps = spec.get("normalizer")
        steps = [] if steps is None else steps.get("normalizers", [steps])
        self.kinds = [s["type"] for s in steps]
        if not {*self.kinds} <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normaliser not supported: {self.kinds}")
        pre = spec["pre_tokenizer"]
        parts = pre.get("pretokenizers", [pre])
        if parts[0]["type"] == "Split":
            self.source = parts[0]["pattern"]["Regex"]
        elif parts[0]["type"] == "ByteLevel" and parts[0].get("use_regex", True):
            self.source = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        else:
            raise ValueError(f"pre-tokenizer not supported: {parts[0]['type']}")
        self.pattern = usual_pattern(self.source)
        self.drops_white = not self.pattern.findall("\n ")

    @functools.cached_property
    def _library(self):
        """The library's normaliser, and its pre-tokenizer up to the split."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        steps = [getattr(normalizers, k)() for k in self.kinds if k != "Replace"]
        return normalizers.Sequence(steps), pre_tokenizers.Split(Regex(self.source), "removed", invert=True)

    def pieces(self, text: str) -> list[str]:
        # runs of white space become one space in some files; their patterns drop it, so nothing is done for that
        if not text.isascii():
            if UNUSUAL.search(text):
                normaliser, split = self._library
                return [p for p, _ in split.pre_tokenize_str(normaliser.normalize_str(text) if self.kinds else text)]
            if "NFC" in self.kinds:
                text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.lower() if "Lowercase" in self.kinds else text)

    def __call__(self, text: str) -> list[str]:
        """The pieces in order; a special string is a piece with a null character before it."""
        if self.at_special is None or not self.at_special.search(text):
            return self.pieces(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                out += self.pieces(part)
        return out


class _Index(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class PieceTable:
    """Distinct pieces and their ids. encode: from a list of pieces to (flat ids, lengths)."""

    def __init__(self, splitter: Splitter, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_pieces: int = MAX_PIECES):
        self.split, self.encode_pieces, self.max_pieces = splitter, encode, max_pieces
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, end to end, and how many each text has."""
        known, number = len(self.index), self.index.__getitem__
        parts = [np.zeros(0, np.int32)]
        for t in texts:
            p = self.split(t)
            parts.append(np.fromiter(map(number, p), np.int32, len(p)))
        new = list(itertools.islice(self.index, known, None))
        if new:
            self._add(new)
        return np.concatenate(parts), np.array([len(p) for p in parts[1:]], np.int64)

    def _add(self, new: list[str]) -> None:
        plain = [i for i, p in enumerate(new) if p[:1] != "\0" or p[1:] not in self.split.special]
        ids, lens = self.encode_pieces([new[i] for i in plain])
        if len(plain) < len(new):  # special strings
            at = np.zeros(len(new), np.int64)
            at[plain] = lens
            special = [i for i in range(len(new)) if i not in {*plain}]
            at[special] = 1
            ends = np.cumsum(at)
            flat = np.zeros(int(ends[-1]), np.int32)
            mask = np.ones(len(flat), bool)
            for i in special:
                flat[ends[i] - 1] = self.split.special[new[i][1:]]
                mask[ends[i] - 1] = False
            flat[mask] = ids
            ids, lens = flat, at
        base = len(self.flat)
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.start = np.concatenate([self.start, base + np.cumsum(lens) - lens])
        self.length = np.concatenate([self.length, lens])

    def _rest(self) -> None:
        if len(self.index) > self.max_pieces:
            self.clear()

    def counts(self, texts: list[str]) -> np.ndarray:
        codes, n = self.codes(texts)
        out = _sums(self.length[codes], n)
        self._rest()
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, end to end, and how many each text has."""
        codes, n = self.codes(texts)
        lens = self.length[codes]
        ends = np.cumsum(lens)
        at = np.repeat(self.start[codes] - (ends - lens), lens)
        at += np.arange(len(at))
        out = self.flat[at], _sums(lens, n)
        self._rest()
        return out


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the first n[0] values, the next n[1] and so on."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


class LibraryPieces:
    """Encodes pieces with the tokenizers library: the file's model without its normaliser and pattern.

    Many pieces are one pretokenized input; where each ends follows from the bytes that tokens stand for.
    """

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer

        bare = dict(spec, normalizer=None, truncation=None, padding=None, post_processor=None, added_tokens=[], pre_tokenizer={"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False})
        self.tokenizer = Tokenizer.from_str(json.dumps(bare))
        self.at_once, self.together = 32_768, 512
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix(suffix))

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), self.at_once):
            part = pieces[i : i + self.at_once]
            found = self.tokenizer.encode_batch_fast([part[j : j + self.together] for j in range(0, len(part), self.together)], is_pretokenized=True, add_special_tokens=False)
            ids = np.array([x for e in found for x in e.ids], np.int32)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in part]), side="left") + 1
            flat.append(ids)
            lens.append(np.diff(ends, prepend=0))
        return np.concatenate(flat), np.concatenate(lens)


_TABLES: dict = {}


def worker_table(path: str, kind: str) -> PieceTable:
    """This Python worker's table for a tokenizer file. kind: library, or pair_index for our own encoder."""
    if (path, kind) not in _TABLES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if kind == "library":
            encode = LibraryPieces(spec)
        else:
            from codelode.llm.bpe import PairIndexEncoder

            encode = PairIndexEncoder(spec)
        _TABLES[path, kind] = PieceTable(Splitter(spec), encode)
    return _TABLES[path, kind]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about so many bytes together (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0)))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
            part = batch.slice(at, end - at)
            yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
            at = end
    release()


def release() -> None:
    """Gives memory that a task has freed back to the system; workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
