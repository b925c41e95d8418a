"""License scans by a positional index over rare licence words.

A template is a label, the words of a notice and its mandatory key phrases. Its
words with their positions are the postings of the index. Words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z lower-cased.

1. How many documents hold each word of the templates is counted over all
   documents; rare words have a high IDF.
2. Of each file the licence words are kept with their places. For each template
   the ``RARE`` words with the highest IDF that the file holds are looked up, at
   all their places, so a file with several licences loses none of them.
3. Places in the file less positions in the template are offsets. Postings are
   intersected by relative position: an offset counts where at least ``AGREE``
   of the looked-up words agree on it to within ``SLACK`` words (a name or a
   year that is filled in shifts the rest).
4. There the mandatory phrases must stand word for word, each within ``SLACK``
   of its relative position. The match's share is the part of the template's
   IDF that stands in its place; it must be ``SHARE`` or more.

A phrase alone (``phrases``) is found in the same way, exactly: the places of
its rarest word give the offsets, and all its words must stand consecutively.
Every place is counted; places may overlap.

The score is the largest share of a match (a phrase has all of its words, so 1),
0 without one. Null and empty texts have no words and no labels. Rows that
repeat are scanned each, whole texts of any length in one row; an empty table
gives no rows. ``carry`` columns whose names meet those of the result come back
with ``_of_row`` appended.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import settle

RARE, AGREE, SLACK, SHARE = 6, 0.6, 12, 0.6

# The phrases of the contract, and notices with their key phrases.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ["permission is hereby granted", "free of charge"]),
    ("mit-notice", "Released under the MIT License", ["mit license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["with or without fee"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met", ["redistribution and use in source and binary forms"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
     ["except in compliance with the license"]),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                   "as published by the Free Software Foundation", ["gnu general public license", "free software"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
     ["gnu affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
     ["waived all copyright"]),
    ("cc-by-notice", "Licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
]

#: Bytes of words as they are, A-Z lower-cased, all others a blank.
_WORDS = bytes(ord(chr(b).lower()) if b < 0x80 and chr(b).isalnum() else b if b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_WORDS).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]     # position and words of a mandatory phrase
    exact: bool                             # a phrase: all words, consecutively

    def __post_init__(self):
        self.at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            self.at[w].append(i)


def _position(words: list[bytes], phrase: list[bytes]) -> int:
    for i in range(len(words) - len(phrase) + 1):
        if words[i:i + len(phrase)] == phrase:
            return i
    raise ValueError(f"the template does not hold its key phrase {phrase}")


def templates_of(phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str, list[str]]] = TEMPLATES) -> list[Template]:
    out = [Template(label, words_of(p), [(0, words_of(p))], True) for label, p in phrases]
    for label, text, keys in notices:
        words = words_of(text)
        out.append(Template(label, words, [(_position(words, words_of(k)), words_of(k)) for k in keys], False))
    return out


class Index:
    """Postings of the templates, with the IDF of their words."""

    def __init__(self, templates: list[Template], found_in: dict[bytes, int], documents: int):
        self.templates = templates
        self.idf = {w: math.log((documents + 1) / (found_in.get(w, 0) + 0.5)) for t in templates for w in t.words}
        self.holding: dict[bytes, list[int]] = defaultdict(list)
        for k, t in enumerate(templates):
            for w in t.at:
                self.holding[w].append(k)

    def rarest(self, words) -> list[bytes]:
        return sorted(words, key=lambda w: (-self.idf[w], w))

    def scan(self, words: list[bytes]) -> tuple[dict[str, list[int]], dict[str, float]]:
        """Places of each phrase, and the share of each notice that is found."""
        holding = self.holding
        here: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in holding:
                here[w].append(i)
        there = Counter(k for w in here for k in holding[w])
        phrases, notices = {}, {}
        for k in there:
            t = self.templates[k]
            if t.exact:
                if there[k] == len(t.at) and (places := self._phrase(t, words, here)):
                    phrases.setdefault(t.label, []).extend(places)
            elif share := self._notice(t, words, here):
                notices[t.label] = max(share, notices.get(t.label, 0.0))
        return phrases, notices

    def _phrase(self, t: Template, words: list[bytes], here: dict[bytes, list[int]]) -> list[int]:
        rare = self.rarest(t.at)[0]
        at = t.at[rare][0]
        return [p - at for p in here[rare] if p >= at and words[p - at:p - at + len(t.words)] == t.words]

    def _notice(self, t: Template, words: list[bytes], here: dict[bytes, list[int]]) -> float:
        """The largest share of the notice that stands at one offset; 0 if the
        words do not agree on one or a mandatory phrase is missing there."""
        if any(w not in here for _, key in t.keys for w in key):
            return 0.0
        rare = self.rarest([w for w in t.at if w in here])[:RARE]
        need = max(1, math.ceil(AGREE * len(rare)))
        votes = sorted((p - q, w) for w in rare for p in here[w] for q in t.at[w])
        best, start, inside = 0.0, 0, Counter()
        tried = None
        for offset, w in votes:
            inside[w] += 1
            while votes[start][0] < offset - SLACK:
                gone = votes[start][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                start += 1
            if len(inside) >= need and (base := votes[start][0]) != tried:
                tried = base
                if all(self._stands(key, base + q, words, here) for q, key in t.keys):
                    best = max(best, self._share(t, base, here))
        return best if best >= SHARE else 0.0

    def _stands(self, key: list[bytes], at: int, words: list[bytes], here: dict[bytes, list[int]]) -> bool:
        first = here[key[0]]
        near = first[bisect_left(first, at - SLACK):bisect_right(first, at + 2 * SLACK)]
        return any(words[p:p + len(key)] == key for p in near)

    def _share(self, t: Template, base: int, here: dict[bytes, list[int]]) -> float:
        whole = found = 0.0
        for q, w in enumerate(t.words):
            whole += self.idf[w]
            some = here.get(w)
            if some:
                i = bisect_left(some, base + q - SLACK)
                if i < len(some) and some[i] <= base + q + 2 * SLACK:
                    found += self.idf[w]
        return found / whole if whole > 0 else 0.0


def _count(vocabulary: frozenset[bytes]):
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], ["word", "n"])
    return run


def build_index(docs: DataFrame, text_col: str = "text", templates: list[Template] | None = None) -> Index:
    """The index with document counts over all of ``docs``; the counts that come
    back are one for each different word of the templates."""
    templates = templates or templates_of()
    vocabulary = frozenset(w for t in templates for w in t.words)
    counted = settle(docs.select(docs[text_col].alias("text")).mapInArrow(_count(vocabulary), "word binary, n long")
                     .groupBy("word").agg(F.sum("n").alias("n")), "words")
    found = {bytes(r.word): r.n for r in counted.collect()}
    return Index(templates, found, docs.count())


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])


def _scan(sent):
    def run(batches):
        index = sent.value
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                phrases, notices = index.scan(words)
                places = sorted(p for some in phrases.values() for p in some)
                rows.append((len(words), len(places), places[0] if places else None, places[-1] if places else None,
                             sorted(phrases), sorted({*phrases, *notices}), 1.0 if places else max(notices.values(), default=0.0)))
            cols = list(zip(*rows)) if rows else [[] for _ in _RESULT]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["_row", *_RESULT.names])
    return run


def scan_licenses(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), index: Index | None = None) -> DataFrame:
    """The ``carry`` columns, ``n_words``, the number of places of phrases and
    the first and last of them (word numbers), ``base_labels`` and ``labels``
    (sorted arrays) and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(index or build_index(docs, text_col))
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("_row"), docs[text_col].alias("_text"))
    found = rows.mapInArrow(_scan(sent), T.StructType([rows.schema["_row"], *_RESULT.fields]))
    return found.select(*[F.col(f"_row.`{c}`").alias(c if c not in _RESULT.names else f"{c}_of_row") for c in carry], *_RESULT.names)
