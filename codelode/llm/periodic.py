"""Periodic runs in texts: stretches of words that repeat themselves with a period, and texts without the repeats.

A run is a stretch with smallest period q (words q apart are equal) of at least `shortest` words and two periods,
which no neighbouring word extends. Within it at least m = max(q, shortest - q) words in a row equal the ones q
later, so the aligned block of s words, s the largest power of two with 2s - 1 <= m, that lies among them occurs
again q words later. For each s an Aho-Corasick automaton over the aligned blocks is run across the text. Its keys are
sequences of whole numbers, the names of a block's halves, which the scale before has given. An occurrence at a
distance whose scale is s is a seed, and each seed is extended word by word to both sides. What has a
smaller period as well is the same stretch and is told by that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import as_text, prepare

SHORTEST = 12
#: Children of an automaton's node at most (they are searched one by one); words that are looked at together.
BASE, TOGETHER = 64, 1 << 18


def scale_of(q: int, shortest: int) -> int:
    """The length of the blocks that find runs of period q."""
    return 1 << (((max(q, shortest - q) + 1) // 2).bit_length() - 1)


def ahead(codes: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    n, step, k = len(codes), 16, 0
    while j + k < n:
        m = min(step, n - j - k)
        other = codes[i + k : i + k + m] != codes[j + k : j + k + m]
        if other.any():
            return k + int(other.argmax())
        k, step = k + m, step * 4
    return k


def behind(codes: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j (i < j)."""
    step, k = 16, 0
    while k < i:
        m = min(step, i - k)
        other = (codes[i - k - m : i - k] != codes[j - k - m : j - k])[::-1]
        if other.any():
            return k + int(other.argmax())
        k, step = k + m, step * 4
    return k


def letters_of(names: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows of digits for names from 0 on. Digits of different places differ, so that matches begin and end with names."""
    most, width = int(names.max()) + 1, 1
    while BASE**width < most:
        width += 1
    places = np.arange(width)
    return names[:, None] // BASE**places % BASE + BASE * places, width


def renamed(names: np.ndarray) -> np.ndarray:
    """names as numbers from 1 on; 0 for those that occur once, whatever they are."""
    _, code, count = np.unique(names, return_inverse=True, return_counts=True)
    again = count > 1
    return np.where(again, np.cumsum(again), 0)[code]


def paired(names: np.ndarray, half: int) -> np.ndarray:
    """Names of twice the length, from those of both halves."""
    left, right = names[: max(len(names) - half, 0)], names[half:]
    return renamed(np.where((left > 0) & (right > 0), left * (int(names.max(initial=0)) + 1) + right, -1 - np.arange(len(left))))


def occurrences(names: np.ndarray, half: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Where in the text the blocks that start at `blocks` stand: places in order, for each which key it is, and each key's blocks.

    A key is the sequence of the names of a block's halves (of the one word, where half is 0). The text is laid out by
    steps of a half, one remainder after the other, so that the names of a block's halves are neighbours.
    """
    step = max(half, 1)
    order = np.argsort(np.arange(len(names)) % step, kind="stable")
    letters, width = letters_of(names)
    keys: dict[tuple[int, ...], list[int]] = {}
    parts = np.concatenate([letters[blocks], letters[blocks + half]], axis=1) if half else letters[blocks]
    for b, key in zip(blocks.tolist(), parts.tolist(), strict=True):
        keys.setdefault(tuple(key), []).append(b)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, key in enumerate(keys):
        automaton.add_word(key, i)
    automaton.make_automaton()
    met = np.array(list(automaton.iter(tuple(letters[order].reshape(-1).tolist()))), np.int64).reshape(-1, 2)
    last = met[:, 0] // width
    place = order[last - 1] if half else order[last]
    fits = order[last] == place + half  # else the end of one remainder and the start of the next
    place, key = place[fits], met[fits, 1]
    sort = np.argsort(place, kind="stable")
    return place[sort], key[sort], list(keys.values())


def runs_of(codes: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(codes)
    if n < shortest:
        return []
    found: dict[tuple[int, int], int] = {}
    #: by word: the last found run of three periods or more that holds it
    holder = np.full(n, -1, np.int64)
    known: list[tuple[int, int, int]] = []
    names, half = renamed(codes), 0
    s = 1
    while names.any():
        near = [q for q in range(1, min(4 * s - 1, shortest, n // 2 + 1)) if scale_of(q, shortest) == s]
        least, most = min([*near, max(2 * s - 1, shortest)]), min(4 * s - 2, n // 2)
        own = names if s == 1 else paired(names, half)
        # a block well inside a run of a period of s or less only meets itself again a multiple of the period later
        inside = np.zeros(n + 1, np.int64)
        for start, end, q in known:
            if q <= s and start <= end - 5 * s + 2:
                inside[start] += 1
                inside[end - 5 * s + 3] -= 1
        blocks = np.arange(0, n - s + 1, s)
        blocks = blocks[(np.cumsum(inside)[blocks] == 0) & (own[blocks] > 0)]
        if least <= most and len(blocks):
            place, key, of = occurrences(names, half, blocks)
            low, high = np.array([x[0] for x in of]), np.array([x[-1] for x in of])
            near_some = (low[key] <= place - least) & (high[key] >= place - most)
            explored: dict[int, int] = {}
            for p, k in zip(place[near_some].tolist(), key[near_some].tolist(), strict=True):
                at = of[k]
                for b in at[bisect_left(at, p - most) : bisect_left(at, p - least + 1)]:
                    d = p - b
                    if b < explored.get(d, 0) or scale_of(d, shortest) != s:
                        continue
                    if (h := holder[b]) >= 0:
                        start, end, q = known[h]
                        if d % q == 0 and p + s <= end and end - start >= d + q:
                            continue  # the same run, by a multiple of its period
                    left, right = b - behind(codes, b, p), b + s + ahead(codes, b + s, p + s)
                    explored[d] = right
                    end = right + d
                    if right - left >= d and end - left >= shortest and found.get((left, end), n) > d:
                        found[left, end] = d
                        if end - left >= 3 * d:
                            holder[left:end] = len(known)
                            known.append((left, end, d))
        names, half, s = own, s, 2 * s
    return sorted(((a, e - a, q) for (a, e), q in found.items()), key=lambda r: (r[0], r[2]))


def live(codes: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Stretches [a, b) of texts laid end to end outside of which no run can be; doc says which text a word is of.

    In a run of length L and period q, every w words in a row (w = shortest / 2, which is at most L - q) of its first
    L - q and of its last L - q words occur in it again, and these two parts cover it. So a run lies
    in a stretch of words that sequences of w words cover which occur more than once in their text.
    """
    w = max(shortest // 2, 1)
    n = len(codes) - w + 1
    if n < 2:
        return []
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = doc[:n].astype(np.uint64)
    for k in range(w):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    own = np.flatnonzero(doc[:n] == doc[w - 1 :])
    order = own[np.argsort(h[own])]
    same = h[order[1:]] == h[order[:-1]]
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    if not len(again):
        return []
    # neighbouring sequences are one stretch as long as they touch and are of one text
    apart = np.flatnonzero((again[1:] > again[:-1] + w) | (doc[again[1:]] != doc[again[:-1]])) + 1
    firsts, lasts = again[np.concatenate([[0], apart])], again[np.concatenate([apart - 1, [len(again) - 1]])] + w
    wide = lasts - firsts >= shortest
    return list(zip(firsts[wide].tolist(), lasts[wide].tolist(), strict=True))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return np.cumsum(gone)[:n] == 0


def searched(texts: list[bytes], shortest: int = SHORTEST) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each text; short texts are looked at together."""
    at = 0
    while at < len(texts):
        words, total, upto = [], 0, at
        while upto < len(texts) and (upto == at or total < TOGETHER):
            words.append(texts[upto].split())
            total += len(words[-1])
            upto += 1
        ids: dict[bytes, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for own in words for w in own), np.int64, total)
        sizes = np.array([len(own) for own in words])
        firsts = np.cumsum(sizes) - sizes
        runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
        doc = np.repeat(np.arange(len(words)), sizes)
        for a, b in live(codes, doc, shortest):
            k = int(doc[a])
            base = a - int(firsts[k])
            runs[k] += [(base + start, length, q) for start, length, q in runs_of(codes[a:b], shortest)]
        for own, found in zip(words, runs, strict=True):
            left = [own[i] for i in np.flatnonzero(kept(len(own), found)).tolist()] if found else own
            yield found, b" ".join(left)
        at = upto


RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string"


def find_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) and text, the collapsed one, for every row of docs.

    Words are what ASCII white space parts. A run's words after its first period are dropped from the collapsed text, whose
    words are joined by one space. Null and empty texts have no runs and collapse to an empty one; rows that repeat, or
    have no doc_id, get a row each. Other columns are ignored. An empty table gives an empty result. Nothing is
    shuffled; a task holds one batch of texts, or the words of one text that is longer.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                runs, texts = zip(*searched(part.column(1).to_pylist(), shortest), strict=True)
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "text"])

    return as_text(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, RUNS)
