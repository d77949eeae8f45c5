"""Licence scans by a positional rare-token index.

Templates are licence notices, a sentence or a whole one. For each template its rarest words (by document frequency over
all documents, however frequent) are looked up, so many that every alignment that fits holds one of
them; they give the places where the template may begin. An alignment counts if the template's mandatory
phrases stand there and enough of its words fit. Document frequencies only decide what is looked up, never the
result. Fixed phrases are labelled wherever their words stand in a row, whatever the index finds.

Document frequencies are counted over all documents for the templates' words only (a few dozen,
fixed), so what the driver gathers is bounded.

Defined results: a null or empty text has no words, labels or score above 0; repeated rows are each
scanned, null ids included; of several templates each that fits gives its label, and the score is the
best fit; a very long text is scanned alone; an empty table gives no row; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flatwords as fw

# Phrases and their labels, in the order in which the labels were given.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# The notices that go with whole licences.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)

TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
    Template("mit", _MIT, ("permission is hereby granted free of charge", "the software is provided as is")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("bsd", _BSD, ("redistribution and use in source and binary forms", "this list of conditions")),
    Template("apache-2", _APACHE, ("apache license version 2", "www apache org licenses")),
    Template("gpl-3", _GNU.format("GNU General Public License", "3"), ("gnu general public license", "version 3 of the license")),
    Template("gpl-2", _GNU.format("GNU General Public License", "2"), ("gnu general public license", "version 2 of the license")),
    Template("lgpl-3", _GNU.format("GNU Lesser General Public License", "3"), ("gnu lesser general public license", "version 3 of the license")),
    Template("agpl-3", _GNU.format("GNU Affero General Public License", "3"), ("gnu affero general public license", "version 3 of the license")),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software",)),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "will the authors be held liable")),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
)

#: Part of a template's words that an alignment needs.
FIT = 0.6
#: More than a text's words.
STRIDE = 1 << 32

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class LicenseIndex:
    """The templates' words, numbered, and how many of them an alignment needs."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES):
        self.templates, self.phrases = templates, phrases
        cut = [words_of(t.text) for t in templates]
        vocabulary = sorted({w for ws in cut for w in ws} | {w for t in templates for k in t.keys for w in words_of(k)} | {w for p, _ in phrases for w in words_of(p)})
        self.vocabulary = vocabulary
        number = {w: i for i, w in enumerate(vocabulary)}
        ids = lambda s: np.array([number[w] for w in words_of(s)], np.int16)
        self.bodies = [ids(t.text) for t in templates]
        self.keys = [[ids(k) for k in t.keys] for t in templates]
        self.phrase_ids = [ids(p) for p, _ in phrases]
        self.least = [next(k for k in range(len(b) + 1) if k / len(b) >= FIT) for b in self.bodies]
        h = np.array([fw.Words([w], fw.ALNUM_LOWER, lower=True).hash[0] for w in vocabulary], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, words: fw.Words) -> np.ndarray:
        """Each word's number in the vocabulary, else -1."""
        out = np.full(len(words.hash), -1, np.int16)
        at = np.flatnonzero(self.maybe[(words.hash & np.uint64(0xFFFF)).astype(np.int64)])
        h = words.hash[at]
        j = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[j] == h
        out[at[hit]] = self.order[j[hit]]
        return out

    def lookups(self, idf: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each template its rarest words with their positions: as many as an alignment that fits
        may lack and one more, so each alignment that fits has one of them."""
        return [sorted(zip(body.tolist(), range(len(body)), strict=True), key=lambda x: -idf[x[0]])[: len(body) - least + 1] for body, least in zip(self.bodies, self.least, strict=True)]

    def align(self, w: fw.Words, numbers: np.ndarray, lookups: list[list[tuple[int, int]]]) -> tuple[list[set[str]], np.ndarray]:
        """Labels of each document and its best fit, from the words' numbers."""
        n = len(w.count)
        labels, best = [set() for _ in range(n)], np.zeros(n)
        for t, body in enumerate(self.bodies):
            keys = []
            for key in self.keys[t]:
                at = places(numbers, key)
                keys.append((at[w.doc[at] == w.doc[at + len(key) - 1]], len(key)))
            if not all(len(at) for at, _ in keys):
                continue
            found = [np.empty(0, np.int64)]
            for word, k in lookups[t]:
                at = np.flatnonzero(numbers == word)
                # the document's number travels with the start, which may lie before its first word
                found.append(w.doc[at] * STRIDE + (at - k - w.first[w.doc[at]] + len(body)))
            doc, start = np.divmod(np.unique(np.concatenate(found)), STRIDE)
            first, last = w.first[doc], w.first[doc + 1]
            start = start - len(body) + first
            lo, hi = np.maximum(start, first), np.minimum(start + len(body), last)
            near = np.ones(len(start), bool)
            for at, size in keys:  # the first key place from 3 words before on ends within 3 words after
                j = np.searchsorted(at, np.maximum(lo - 3, first))
                near &= (j < len(at)) & (at[np.minimum(j, len(at) - 1)] + size <= np.minimum(hi + 3, last))
            doc, start, first, last = doc[near], start[near], first[near], last[near]
            same = np.zeros(len(start), np.int64)
            for k, word in enumerate(body.tolist()):
                at = start + k
                same += (at >= first) & (at < last) & (numbers[np.clip(at, 0, len(numbers) - 1)] == word)
            fits = same >= self.least[t]
            np.maximum.at(best, doc[fits], same[fits] / len(body))
            for d in np.unique(doc[fits]).tolist():
                labels[d].add(self.templates[t].label)
        return labels, best


def places(numbers: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand in a row."""
    at = np.flatnonzero(numbers[: len(numbers) - len(phrase) + 1] == phrase[0]) if len(numbers) >= len(phrase) else np.empty(0, np.int64)
    for k in range(1, len(phrase)):
        at = at[numbers[at + k] == phrase[k]]
    return at


def _count(index: LicenseIndex):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            texts = fw.binary_texts(batch.column(0))
            docs += len(texts)
            for lo, hi in fw.slices(texts):
                w = fw.Words(texts[lo:hi], fw.ALNUM_LOWER, lower=True)
                v = index.numbers(w)
                at = np.flatnonzero(v >= 0)
                both = np.unique(w.doc[at] * len(index.vocabulary) + v[at])
                total += np.bincount(both % len(index.vocabulary), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([docs, *total.tolist()], pa.int64())], ["word", "n"])

    return count


def _scanner(index: LicenseIndex, idf: np.ndarray):
    lookups = index.lookups(idf)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = fw.binary_texts(batch.column(1))
            for lo, hi in fw.slices(texts):
                w = fw.Words(texts[lo:hi], fw.ALNUM_LOWER, lower=True)
                v = index.numbers(w)
                n = hi - lo
                base, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
                of: list[set[str]] = [set() for _ in range(n)]
                for phrase, (_, label) in zip(index.phrase_ids, index.phrases, strict=True):
                    at = places(v, phrase)
                    at = at[w.doc[at] == w.doc[at + len(phrase) - 1]]
                    for d, p in zip(w.doc[at].tolist(), (at - w.first[w.doc[at]]).tolist(), strict=True):
                        first[d] = p if first[d] < 0 else min(first[d], p)
                        last[d] = max(last[d], p)
                        base[d] += 1
                        of[d].add(label)
                more, best = index.align(w, v, lookups)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n), pa.array(w.count, pa.int64()), pa.array(base, pa.int64()), pa.array(first, pa.int64(), mask=first < 0), pa.array(last, pa.int64(), mask=last < 0),
                        pa.array([",".join(sorted(x)) for x in of]), pa.array([",".join(sorted(x | y)) for x, y in zip(of, more, strict=True)]), pa.array([1.0 if x else b for x, b in zip(of, best.tolist(), strict=True)], pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return scan


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LicenseIndex | None = None) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row.

    A score of 1 means that a fixed phrase or a whole template stands there, 0 that nothing does.
    """
    index = index or LicenseIndex()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = docs.select("text").mapInArrow(_count(index), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in counted}
    df = np.array([n.get(i, 0) for i in range(len(index.vocabulary))], np.float64)
    # above 0 for any word, as no word is in more documents than there are
    idf = np.log((max(n.get(-1, 0), 1) + 1) / (df + 0.5))
    return docs.mapInArrow(_scanner(index, idf), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
