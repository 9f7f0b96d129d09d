"""License scan: an exact set-similarity join of text blocks with license templates.

A block of a template T is a run of words of the whole text, whatever its line breaks: it starts at a word of T and has as many words as T and a quarter more (two at
least). A block B meets T when |T & B| >= CONTAINMENT * |T|, on word sets, B has the words that name the license, and none that name another one. Tokens are ordered by
their frequency over the whole corpus, rarest first. With o = ceil(CONTAINMENT * |T|), a text that has a block for T has one of the first |T| - o + 1 tokens of T (prefix
filter) and at least o distinct tokens of T (length filter); a block from the i-th place of T's tokens in the text on needs o places to be left (positional
filter). What is left is counted exactly, by one sweep over those places.

The templates are fixed and few, so their index is shipped with the task; blocks are never shuffled. The corpus frequencies
of the templates' tokens come from one pass that sends a row for each token and partition at most.

Also finds the places of the base phrases. Defined results: null text counts as empty; empty texts have no words, labels ''
and score 0; null ids and repeated rows each get their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CONTAINMENT = 0.8
#: Base phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Standard notices of public licenses: the label that this scan adds, the text, words that must stand in the block, words that must not.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache", ""),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission", ""),
    ("mit-notice", "Released under the MIT License", "mit", ""),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu", ""),
    ("gpl-notice", "This work is licensed under the GNU General Public License", "gnu general", ""),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution", ""),
    ("bsd-notice", "Released under the BSD License", "bsd", ""),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons", "noncommercial sharealike noderivatives"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by", "nc sa nd"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc nc", "sa nd"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc sa", "nc nd"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla", ""),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered", ""),
    ("all-rights-reserved", "Copyright all rights reserved", "copyright reserved", ""),
)


def words(text: str) -> list[str]:
    return WORDS.findall(text.translate(_LOWER))


def block_words(text: str) -> int:
    """Words of a block for a template of this text."""
    n = len(words(text))
    return n + max(2, n // 4)


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]  # distinct, in the global order
    need: int
    size: int  # words of a block
    must: frozenset[str]
    without: frozenset[str]

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


@dataclass(frozen=True)
class Index:
    templates: tuple[Template, ...]
    vocabulary: frozenset[str]
    prefixes: frozenset[str]

    def search(self, found: list[str]) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, containment) of the blocks of a whole text's words that meet a template; overlapping ones of a template are one, with the best containment."""
        if self.prefixes.isdisjoint(found):
            return []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(found):
            if w in self.vocabulary:
                at.setdefault(w, []).append(i)
        out = []
        for k, t in enumerate(self.templates):
            if any(x in at for x in t.prefix) and sum(x in at for x in t.tokens) >= t.need and all(x in at for x in t.must):
                out += [(k, *x) for x in _sweep(t, at)]
        return out


def _sweep(t: Template, at: dict[str, list[int]]) -> list[tuple[int, int, float]]:
    places = sorted((i, x) for x in t.tokens if x in at for i in at[x])
    other = sorted(i for x in t.without if x in at for i in at[x])
    inside: dict[str, int] = {}
    out: list[list] = []
    stop = 0
    for k, (start, first) in enumerate(places):
        if len(places) - k < t.need:
            break
        while stop < len(places) and places[stop][0] < start + t.size:
            inside[places[stop][1]] = inside.get(places[stop][1], 0) + 1
            stop += 1
        if len(inside) >= t.need and all(x in inside for x in t.must):
            o = bisect_left(other, start)
            if o == len(other) or other[o] >= start + t.size:
                share, end = len(inside) / len(t.tokens), places[stop - 1][0] + 1
                if out and start < out[-1][1]:
                    out[-1][1:] = [end, max(share, out[-1][2])]
                else:
                    out.append([start, end, share])
        inside[first] -= 1
        if not inside[first]:
            del inside[first]
    return [tuple(x) for x in out]


def index(frequency: dict[str, int], templates=TEMPLATES, containment: float = CONTAINMENT) -> Index:
    rows = []
    for label, text, must, without in templates:
        tokens = tuple(sorted(set(words(text)), key=lambda w: (frequency.get(w, 0), w)))
        rows.append(Template(label, tokens, math.ceil(containment * len(tokens) - 1e-9), block_words(text), frozenset(must.split()), frozenset(without.split())))
    return Index(tuple(rows), frozenset(w for t in rows for w in (*t.tokens, *t.without)), frozenset(w for t in rows for w in t.prefix))


def _frequencies(batches, vocabulary):
    n = dict.fromkeys(vocabulary, 0)
    for b in batches:
        for text in b["text"].to_pylist():
            low = text.translate(_LOWER)
            for w in vocabulary.intersection(WORDS.findall(low)):
                n[w] += 1
    found = [w for w in n if n[w]]
    yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "n": pa.array([n[w] for w in found], pa.int64())})


def corpus_index(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> Index:
    """The index under the token frequencies (documents that have the token) of the whole corpus."""
    vocabulary = frozenset(w for _, t, *_ in templates for w in words(t))
    counts = arrow_map(texts(docs).select("text"), partial(_frequencies, vocabulary=vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each template token
    return index({r.word: r.n for r in counts}, templates, containment)


def places(found: list[str]) -> list[tuple[int, str]]:
    """(first word's index, label) of each place of a base phrase."""
    out = []
    at = -1
    for _ in range(found.count("license")):
        at = found.index("license", at + 1)
        for phrase, label in PHRASES.items():
            n = len(phrase)
            if at >= n - 1 and tuple(found[at - n + 1 : at + 1]) == phrase:
                out.append((at - n + 1, label))
    return out


def _scan(batches, idx):
    for b in batches:
        rows = []
        for text in b["text"].to_pylist():
            found = words(text)
            base, met = places(found), idx.search(found)
            if met:
                spans = [m.span() for m in WORDS.finditer(text.translate(_LOWER))]
                met = [(idx.templates[k].label, spans[first][0], spans[last - 1][1], c) for k, first, last, c in met]
            starts = [s for s, _ in base]
            base_labels = sorted({x for _, x in base})
            rows.append((
                len(found), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(sorted({*base_labels, *(m[0] for m in met)})),
                max([float(bool(base)), *(m[3] for m in met)]), [dict(zip(("label", "start", "end", "containment"), m)) for m in met],
            ))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), BLOCKS)
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])


BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def scan(docs: DataFrame, idx: Index | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (label, start, end, containment).

    score is the greatest containment found; a base phrase counts as a template that is wholly contained.
    """
    return arrow_map(
        texts(docs), partial(_scan, idx=idx or corpus_index(docs)),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,start:long,end:long,containment:double>>",
    )
