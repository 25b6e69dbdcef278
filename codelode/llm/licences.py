"""Licence notices in texts, by a positional index of rare words.

Templates are short notices. Of a template's words, weighted by how rare they are among all documents, the rarest
ones are looked up in each text: enough of them that a text which holds none cannot reach the share of weight
that a notice needs. Each one found says where the template would have to start; the postings of all its words are
intersected by that relative position, and where they weigh enough the template's mandatory phrases must stand.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import as_text, prepare

#: A-Z in lower case; 0-9, a-z and bytes of other letters stay; all else parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The share of a template's weight that has to stand at a place, and by how many words words may be off theirs.
SHARE, SLACK = 0.6, 3


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


@dataclass(frozen=True)
class Template:
    """A notice: its label, its text, and phrases of it that have to stand in a text word by word (beside others, in any number)."""

    label: str
    text: str
    phrases: tuple[str, ...]
    words: tuple[bytes, ...] = field(init=False)
    musts: tuple[tuple[int, tuple[bytes, ...]], ...] = field(init=False)

    def __post_init__(self):
        words = tuple(words_of(self.text.encode()))
        object.__setattr__(self, "words", words)
        musts = []
        for phrase in self.phrases:
            own = tuple(words_of(phrase.encode()))
            musts.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
        object.__setattr__(self, "musts", tuple(musts))


# fixed values: phrases that name a licence, with their labels
BASE = (
    Template("gpl", "gnu general public license", ("gnu general public license",)),
    Template("apache", "apache license", ("apache license",)),
    Template("cc-by", "cc by", ("cc by",)),
    Template("mit", "mit license", ("mit license",)),
)
# fixed values: customary wordings of licence notices
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License, Version 2.0",)),
    Template("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("in compliance with the License", "www.apache.org")),
    Template("mit", "Released under the MIT License", ("MIT License",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("Permission is hereby granted, free of charge", "without restriction")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("GNU General Public License", "version 2")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("GNU General Public License", "version 3")),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("GNU General Public License", "Free Software Foundation")),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("GNU Lesser General Public License",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("GNU Affero General Public License",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("Redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License, v. 2.0",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("CC BY 4.0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    Template("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("CC0 1.0",)),
)


@dataclass(frozen=True)
class Index:
    """Templates with the weights of their words, and their rarest words."""

    templates: tuple[Template, ...]
    weight: dict[bytes, int]
    share: float
    slack: int

    def least(self, t: Template) -> float:
        return self.share * sum(self.weight[w] for w in t.words)

    def rare(self, t: Template) -> set[bytes]:
        """The rarest words of a template: the places of the others don't weigh enough for a notice (ties by the word's bytes)."""
        rest, out = sum(self.weight[w] for w in t.words), set()
        for w in sorted(set(t.words), key=lambda w: (-self.weight[w], w)):
            if rest < self.least(t):
                break
            out.add(w)
            rest -= self.weight[w] * t.words.count(w)
        return out


def index(docs: DataFrame, templates: Iterable[Template] = TEMPLATES, share: float = SHARE, slack: int = SLACK) -> Index:
    """The index of templates whose words are weighed by all texts of docs.

    A word's weight is 1 + floor(1000 ln((N + 1) / (n + 1))) where n of N texts hold it; what comes to the driver is
    one number a word of the templates. Null texts are empty and count; rows that repeat count each.
    """
    prepare(docs.sparkSession)
    templates = tuple(templates)
    vocabulary = sorted({w for t in (*templates, *BASE) for w in t.words})

    def run(batches):
        at, n = {w: i for i, w in enumerate(vocabulary)}, np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[[at[w] for w in at.keys() & words_of(text)]] += 1
                n[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["word", "n"])

    texts = as_text(docs).select(F.col("text").cast("binary"))
    n = dict.fromkeys(range(len(vocabulary) + 1), 0) | dict(map(tuple, texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect()))
    total = n[len(vocabulary)]
    return Index(templates, {w: 1 + math.floor(1000 * math.log((total + 1) / (n[i] + 1))) for i, w in enumerate(vocabulary)}, share, slack)


def phrase_places(words: list[bytes], at: dict[bytes, list[int]], phrase: tuple[bytes, ...], rarest: int) -> list[int]:
    """Where a phrase stands word by word; at has the places of its rarest word."""
    n = len(phrase)
    return [i - rarest for i in at.get(phrase[rarest], ()) if i >= rarest and tuple(words[i - rarest : i - rarest + n]) == phrase]


def notice_places(words: list[bytes], at: dict[bytes, list[int]], t: Template, rare: set[bytes], weight: dict[bytes, int], least: float, slack: int) -> list[tuple[int, int]]:
    """(start, weight) of the best place of each group of neighbouring places where a template stands."""
    if not any(w in at for w in rare):
        return []
    offset = len(t.words) + slack
    met = np.zeros(len(words) + offset + slack + 1, np.int64)
    off = np.arange(-slack, slack + 1)
    for j, w in enumerate(t.words):
        if w in at:
            near = (np.array(at[w], np.int64)[:, None] - j + offset + off).reshape(-1)
            met[np.unique(near) if len(at[w]) > 1 else near] += weight[w]
    out: list[tuple[int, int]] = []
    last = None
    for o in np.flatnonzero(met >= least).tolist():
        start = o - offset
        if all(any(i >= 0 and tuple(words[i : i + len(p)]) == p for i in range(start + k - slack, start + k + slack + 1)) for k, p in t.musts):
            if last is not None and o - last <= slack:
                out[-1] = max(out[-1], (start, int(met[o])), key=lambda x: (x[1], -x[0]))
            else:
                out.append((start, int(met[o])))
            last = o
    return out


FOUND = "doc_id long, n_words long, base array<struct<label: string, start: long>>, notices array<struct<label: string, start: long, share: double>>"


def scan(docs: DataFrame, by: Index) -> DataFrame:
    """doc_id, n_words, base (label and start of each phrase of BASE) and notices (label, start, share) of every row of docs.

    Words are runs of ASCII letters and digits and all other characters beyond ASCII, in lower case as far as ASCII goes. A notice
    stands where words that have by.share of a template's weight are each at most by.slack words off their place and
    all its mandatory phrases stand word by word, no farther off; neighbouring places are one notice, its start
    (below 0 if the text begins within it) the best of them. Null and empty texts have no words and no notices. Rows that
    repeat or have no doc_id get a row each; other columns are ignored; an empty table gives an empty result.
    Nothing is shuffled.
    """
    prepare(docs.sparkSession)

    def run(batches):
        weight = by.weight
        rarest = [(t, min(range(len(t.words)), key=lambda i, t=t: (-weight[t.words[i]], t.words[i]))) for t in BASE]
        of = [(t, by.rare(t), by.least(t), sum(weight[w] for w in t.words)) for t in by.templates]
        for batch in batches:
            sizes, base, notices = [], [], []
            for text in batch.column(1).to_pylist():
                words, at = words_of(text), {}
                for i, w in enumerate(words):
                    if w in weight:
                        at.setdefault(w, []).append(i)
                sizes.append(len(words))
                base.append([{"label": t.label, "start": i} for t, k in rarest for i in phrase_places(words, at, t.words, k)] if at else [])
                notices.append([{"label": t.label, "start": i, "share": got / total} for t, rare, least, total in of for i, got in notice_places(words, at, t, rare, weight, least, by.slack)] if at else [])
            kinds = [pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(base, kinds[0]), pa.array(notices, kinds[1])], ["doc_id", "n_words", "base", "notices"])

    return as_text(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, FOUND)
