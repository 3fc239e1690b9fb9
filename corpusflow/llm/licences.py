"""Licence notices by a positional index of rare template words.

The templates' words are indexed by position.  Document frequencies of those words over the whole
corpus give their weights.  Of each template the rarest words are looked up, so many that one without
any of them in place cannot reach the share: an occurrence at p that the template has at q proposes it at
offset p - q, and every proposal is verified, so no other licence or word of the text can hide it.  A template
at an offset is accepted when several of its words stand at their relative position, their weight is a large
share of the whole, and every mandatory key phrase of the template stands in the aligned stretch.

Base labels are independent of that: every place where a base phrase's words stand consecutively counts.
Both passes are narrow; only counts of the template vocabulary, bounded by the templates, are gathered.

Defined results
  NULL and empty texts have no words, no labels and score 0.  Very long texts are read whole; overlapping
  phrases all count.  Every accepted (label, template, offset) is a match of its own; a label counts once.
  The score is the largest accepted share, or 1 where a base phrase stands.
"""
from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import add_columns, slices, with_columns, words_of

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence notices as their authors word them, and the phrases that must stand in a match.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("general public license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved", "Copyright. All rights reserved.", ("all rights reserved",)),
)
#: Words that have to stand in place at the same offset.
AGREE = 2
#: Share of a template's weight that has to stand in place.
SHARE = 0.75


def _phrase(text: str) -> list[bytes]:
    return words_of(text)


class Index:
    """Template word -> (template, position) postings, and weights from document frequencies."""

    def __init__(self, frequency: dict[bytes, int] | None = None, documents: int = 0):
        self.templates = [(label, _phrase(text), [_phrase(k) for k in keys]) for label, text, keys in TEMPLATES]
        self.base = [(_phrase(p), label) for p, label in BASE.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(self.templates):
            for q, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, q))
        self.vocabulary = set(self.postings).union(*(p for p, _ in self.base))
        frequency = frequency or {}
        self.weight = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1e-3 for w in self.vocabulary}
        self.total = [sum(self.weight[w] for w in words) for _, words, _ in self.templates]
        self.rare = [self._rarest(words, total) for (_, words, _), total in zip(self.templates, self.total)]

    def _rarest(self, words: list[bytes], total: float) -> list[tuple[bytes, list[int]]]:
        """Rarest words with their positions; what is left of the template weighs less than its share."""
        out, left = [], total
        for w in sorted(set(words), key=lambda w: (-self.weight[w], w)):
            if left < SHARE * total * (1 - 1e-9):
                break
            at = [q for q, v in enumerate(words) if v == w]
            out.append((w, at))
            left -= len(at) * self.weight[w]
        return out


def places(words: list[bytes], phrase: list[bytes], starts: list[int]) -> list[int]:
    return [i for i in starts if words[i:i + len(phrase)] == phrase]


def scan_words(words: list[bytes], index: Index) -> dict:
    """Base places and labels, accepted templates with offsets and shares."""
    at: dict[bytes, list[int]] = {}
    for w in index.vocabulary.intersection(words):
        at[w] = []
    if at:
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
    base = [(i, label) for phrase, label in index.base for i in places(words, phrase, at.get(phrase[0], []))]
    proposed = {(t, p - q) for t, rare in enumerate(index.rare) for w, positions in rare for p in at.get(w, ()) for q in positions}
    matches: list[tuple[str, float, int, int]] = []
    for t, offset in sorted(proposed):
        label, template, keys = index.templates[t]
        inside = [w for q, w in enumerate(template) if 0 <= offset + q < len(words) and words[offset + q] == w]
        if len(set(inside)) < AGREE:
            continue
        share = sum(index.weight[w] for w in inside) / index.total[t]
        if share < SHARE:
            continue
        stretch = words[max(0, offset):offset + len(template)]
        if all(any(stretch[i:i + len(k)] == k for i in range(len(stretch))) for k in keys):
            matches.append((label, share, max(0, offset), t))
    return {"base": sorted(base), "matches": sorted(matches, key=lambda m: (m[0], m[2], m[3]))}


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """Documents that hold each template word, and documents at all; counted over every document."""
    def run(batches):
        vocabulary = Index().vocabulary
        seen: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            for start, stop in slices(batch.column(text_col)):
                for text in batch.column(text_col).slice(start, stop - start).to_pylist():
                    rows += 1
                    for w in vocabulary.intersection(words_of(text)):
                        seen[w] = seen.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": [None, *seen], "n": [rows, *seen.values()]},
                                         schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))
    counted = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.word) if r.word is not None else None: r.n for r in counted}
    return {w: n for w, n in found.items() if w is not None}, found.get(None, 0)


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType()),
                                                       T.StructField("first_word", T.LongType()), T.StructField("template", T.LongType())])))])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, labels, score and accepted templates."""
    frequency, documents = frequencies(docs, text_col)
    match = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("first_word", pa.int64()), ("template", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]

    def run(batches):
        index = Index(frequency, documents)
        for whole in batches:
            for start, stop in slices(whole.column(text_col)):
                batch = whole.slice(start, stop - start)
                out = [[] for _ in kinds]
                for text in batch.column(text_col).to_pylist():
                    words = words_of(text)
                    found = scan_words(words, index)
                    base, matches = found["base"], found["matches"]
                    names = {label for _, label in base}
                    row = (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                           ",".join(sorted(names)), ",".join(sorted(names | {m[0] for m in matches})),
                           1.0 if base else min(1.0, max((m[1] for m in matches), default=0.0)),
                           [{"label": a, "share": min(1.0, b), "first_word": c, "template": d} for a, b, c, d in matches])
                    for column, value in zip(out, row):
                        column.append(value)
                yield add_columns(batch, {f.name: pa.array(v, k) for f, v, k in zip(FOUND, out, kinds)})
    return docs.mapInArrow(run, with_columns(docs.schema, FOUND))
