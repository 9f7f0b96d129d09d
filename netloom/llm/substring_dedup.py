"""Substring deduplication by paragraph MinHash banding.

Paragraphs are the lines of whole texts with at least MIN_WORDS words. Paragraphs with equal sets of 5-word shingles are one class.
tune() picks the bands: of all (bands, rows) within COORDINATES the one with the fewest expected false collisions whose recall at the
threshold similarity is at least RECALL. Classes that share a band collide; exact Jaccard on the full sets confirms; linkage.py
finds the components without writing out a band's pairs. In each component the first paragraph (smallest doc_id, then line) stays, the others are removals.

Passages stand anywhere: inside a longer line, or wrapped over several lines. Line breaks count as blanks here. Of every WINDOW adjacent 5-word
shingles of a text the one with the least hash is an anchor, and the UNIT words from there are a unit. Two texts that share PASSAGE = UNIT + WINDOW - 1 words
have a whole unit in common there, and adjacent units leave no gap, so every verbatim run of PASSAGE words that documents share is found, whatever is around it;
one of UNIT words or more may be, a shorter one never is. Of equal units the first stays. The others, less what removed lines cover, are joined to
runs; a run of at least MIN_WORDS words is a removal with no component. With within = False only repeats across documents count: what stays in its own document for a paragraph or unit is no removal.
A passage that is not verbatim is found by its verbatim runs, or as a line. Runs with different kept documents may overlap.

Defined results: null and empty texts have no paragraphs; rows with a null id take no part; repeated rows are further occurrences of their
paragraphs; ties go to the smallest (doc_id, line, start); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_map, chain, cut, forget, sized, texts
from .linkage import SETS, link

MIN_WORDS, COORDINATES, RECALL = 20, 64, 0.995
#: Words of a unit, a multiple of a shingle's, and how many adjacent shingles have an anchor. A longer unit leaves more short repeats alone, a shorter window makes more units.
UNIT, WINDOW = 35, 16
PASSAGE = UNIT + WINDOW - 1
#: Low bits of a shingle's hash that hold its place while anchors are chosen.
PLACE = np.uint64(30)
#: Most documents with candidates whose ids and lines are broadcast; beyond it the join shuffles.
BROADCAST_DOCS = 200_000


def tune(similarity: float = shingles.PERCENT / 100, recall: float = RECALL, coordinates: int = COORDINATES) -> tuple[int, int]:
    """(bands, rows)."""
    found = []
    grid = np.linspace(0, similarity * 0.8, 50)
    for rows in range(1, 17):
        for bands in range(1, coordinates // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                found.append((float((1 - (1 - grid**rows) ** bands).mean()), bands * rows, bands, rows))
    return min(found)[2:]


class Words(NamedTuple):
    """A whole text: bytes, first byte of each word, shingle at each word, line breaks, code points before each byte."""

    data: np.ndarray
    first: np.ndarray
    shingle: np.ndarray
    breaks: np.ndarray
    chars: np.ndarray


def read(text: str) -> Words | None:
    """None for a text of fewer than MIN_WORDS words, which has neither paragraphs nor units."""
    data = shingles.encoded(text)
    h, first = shingles.word_hashes(data)
    if len(h) < MIN_WORDS:
        return None
    x = np.frombuffer(data, np.uint8)
    chars = np.zeros(len(x) + 1, np.int64)
    np.cumsum((x & 0xC0) != 0x80, out=chars[1:])
    return Words(x, first, shingles.runs(h, shingles.WIDTH), np.flatnonzero(x == 10), chars)


def paragraphs(text: Words) -> tuple[np.ndarray, ...]:
    """line, start, end (code points), first word, word after the last of the paragraphs of a whole text, their sorted distinct shingles end to end, and where each one's begin."""
    x, first, s, breaks, chars = text
    line = np.searchsorted(breaks, first)
    n_words = np.bincount(line, minlength=len(breaks) + 1)
    long = n_words >= MIN_WORDS
    k = shingles.WIDTH
    own = (line[: len(s)] == line[k - 1 :]) & long[line[: len(s)]]
    s, at = s[own], line[: len(s)][own]
    order = np.lexsort((s, at))
    s, at = s[order], at[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
    s, at = s[new], at[new]
    lines, begin = np.unique(at, return_index=True)
    edges = np.concatenate([[-1], breaks, [len(x)]])
    before = np.concatenate([[0], np.cumsum(n_words)])
    return lines, chars[edges[lines] + 1], chars[edges[lines + 1]], before[lines], before[lines + 1], s, begin


def units(text: Words) -> tuple[np.ndarray, ...]:
    """line, start, end (code points), first word, word after the last, and hash of the units of a whole text; equal ones do not overlap."""
    x, first, s, breaks, chars = text
    k = shingles.WIDTH
    none = np.empty(0, np.int64)
    if len(s) < WINDOW or len(first) < UNIT:
        return none, none, none, none, none, none
    least = (s >> PLACE << PLACE) | np.arange(len(s), dtype=np.uint64)
    width = 1
    while width < WINDOW:  # the least of `width` adjacent ones, doubled up to WINDOW
        step = min(width, WINDOW - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.unique(least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    at = at[at + UNIT <= len(first)]
    key = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(0, UNIT, k):
            key = (key ^ s[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
    if len(np.unique(key)) < len(key):
        free: dict[int, int] = {}
        keep = np.zeros(len(at), bool)
        for n, (q, p) in enumerate(zip(key.tolist(), at.tolist())):
            if p >= free.get(q, 0):
                keep[n], free[q] = True, p + UNIT
        at, key = at[keep], key[keep]
    blanks = np.append(np.flatnonzero(shingles._BLANK[x]), len(x))
    stop = blanks[np.searchsorted(blanks, first[at + UNIT - 1])]
    return np.searchsorted(breaks, first[at]), chars[first[at]], chars[stop], at, at + UNIT, key.view(np.int64)


def runs(found: list[dict], lines: list[dict]) -> list[dict]:
    """The runs of one document's repeated units, less its removed lines, of at least MIN_WORDS words."""
    lines = sorted({(x["word"], x["stop"], x["start"], x["end"], x["line"]) for x in lines})
    starts = [x[0] for x in lines]
    out: list[dict] = []
    for u in sorted(found, key=lambda x: (x["keep_doc_id"], x["word"], x["keep_line"])):
        pieces = [u]
        for word, stop, start, end, line in lines[max(0, bisect_right(starts, u["word"]) - 1) :]:
            own = pieces[-1]
            if word >= own["stop"]:
                break
            if stop > own["word"]:  # what stands before the line, and what stands after it
                pieces[-1:] = [own | {"stop": word, "end": start - 1}] * (word > own["word"]) + [own | {"word": stop, "start": end + 1, "line": line + 1}] * (stop < own["stop"])
                if stop >= own["stop"]:
                    break
        for p in pieces:
            if out and out[-1]["keep_doc_id"] == p["keep_doc_id"] and p["word"] <= out[-1]["stop"]:
                if p["stop"] > out[-1]["stop"]:
                    out[-1] |= {"stop": p["stop"], "end": p["end"]}
            else:
                out.append(dict(p))
    return [x for x in out if x["stop"] - x["word"] >= MIN_WORDS]


def _runs(batches):
    for b in batches:
        rows = [(i, x["line"], x["start"], x["end"], x["keep_doc_id"], x["keep_line"], None) for i, u, v in zip(b["doc_id"].to_pylist(), b["units"].to_pylist(), b["lines"].to_pylist()) for x in runs(u, v or [])]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "line", "start", "end", "keep_doc_id", "keep_line", "component"])


PIECES = "doc_id long, line int, start long, end long, word long, stop long, key binary, bands array<long>, unit long"


def _pieces(batches, bands, rows):
    """The paragraphs (with key and bands) and the units (with unit) of whole texts, from one reading."""
    a, b = shingles.coefficients(bands * rows)
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        keys, band_rows, unit_rows, split = [], [], [], []
        for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            words = read(text)
            if words is None:
                continue
            *place, s, begin = paragraphs(words)
            *unit_place, unit = units(words)
            for c, v, w in zip(cols, (np.full(len(begin), i), *place), (np.full(len(unit), i), *unit_place)):
                c += [v, w]
            split += [len(begin), len(unit)]
            unit_rows.append(unit)
            if not len(begin):
                continue
            with np.errstate(over="ignore"):
                sig = np.concatenate([np.minimum.reduceat(s[lo:hi, None] * a + b, begin[j : j + 64] - lo, axis=0) for j, lo, hi in ((j, begin[j], begin[j + 64] if j + 64 < len(begin) else len(s)) for j in range(0, len(begin), 64))])
                sig = (sig >> np.uint64(33)).reshape(len(begin), bands, rows)
                band = np.zeros((len(begin), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    band = (band ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    band ^= band >> np.uint64(32)
            keys += [xxhash.xxh3_128_digest(s[p:q].tobytes()) for p, q in zip(begin, np.append(begin[1:], len(s)))]
            band_rows.append(band.view(np.int64).ravel())
        flat = lambda c, kind: pa.array(np.concatenate(c).astype(kind) if c else np.empty(0, kind))
        is_unit = np.repeat(np.arange(len(split)) % 2 == 1, np.array(split, np.int64))
        # the n-th paragraph takes the n-th key and bands, the n-th unit the n-th hash; the rest is null
        line_at = pa.array(np.cumsum(~is_unit) - 1, pa.int64(), mask=is_unit)
        unit_at = pa.array(np.cumsum(is_unit) - 1, pa.int64(), mask=~is_unit)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), flat(band_rows, np.int64))
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int64, np.int64)
        own = [flat(c, kind) for c, kind in zip(cols, kinds)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary()).take(line_at), lists.take(line_at), flat(unit_rows, np.int64).take(unit_at)], names=["doc_id", "line", "start", "end", "word", "stop", "key", "bands", "unit"])


def _sets(batches):
    for b in batches:
        ids, sets = [], []
        for text, want in zip(b["text"].to_pylist(), b["want"].to_pylist()):
            every = text.split("\n")
            for w in want:
                ids.append(w["id"])
                sets.append(shingles.shingles(every[w["line"]] if w["line"] < len(every) else "").tobytes())
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "set": pa.array(sets, pa.binary())})


def removals(docs: DataFrame, within: bool = True) -> DataFrame:
    """(doc_id, line, start, end, keep_doc_id, keep_line, component) of every paragraph to remove, and the one that stays for it.

    within: also repeats whose kept place is in the same document.
    """
    bands, rows = tune()
    own = texts(docs).where("doc_id is not null")
    pieces = cut(arrow_map(own, partial(_pieces, bands=bands, rows=rows), PIECES), "pieces")
    found = pieces.where("key is not null").drop("unit")
    classes = found.groupBy("key").agg(F.min(F.struct("doc_id", "line", "start")).alias("first"), F.first("bands").alias("bands"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "key", "first", "bands"), "classes")
    tokens = classes.select("id", F.explode("bands").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    # a class's weight is how common its bands are: the pivot of a list is its most central member
    central = tokens.join(often, "token").groupBy("id").agg(F.sum("n").alias("weight"), F.collect_list("token").alias("tokens"))
    posted = cut(central.select(F.explode("tokens").alias("token"), "id", "weight"), "postings")

    def sets(ids: DataFrame, then=None, schema: str = SETS) -> DataFrame:
        want = cut(classes.join(ids, "id", "left_semi").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "id")).alias("want")), "want")
        return arrow_map(own.join(sized(want, BROADCAST_DOCS), "doc_id").select("text", "want"), chain(_sets, then), schema)

    comp = link(posted, None, 1, sets)
    forget(posted)
    of = classes.join(comp, "id", "left").select("key", "first", F.coalesce("component", "id").alias("component"))
    of = cut(of, "class-components")
    best = of.groupBy("component").agg(F.min("first").alias("keep"))
    of = of.join(best, "component").select("key", "component", "keep")
    out = found.select("doc_id", "line", "start", "end", "word", "stop", "key").join(of, "key").where((F.struct("doc_id", "line", "start") != F.col("keep")) & (F.lit(within) | (F.col("doc_id") != F.col("keep.doc_id"))))
    lines = cut(out.select("doc_id", "line", "start", "end", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), "component", "word", "stop"), "lines")
    again = repeated(pieces.where("unit is not null").drop("key", "bands"), within)
    forget(pieces, of)
    return lines.drop("word", "stop").unionByName(passages(again, lines))


def repeated(every: DataFrame, within: bool) -> DataFrame:
    """The units that stand in several places, or unless `within` in several documents, with the least document as `first`, a table."""
    often = every.groupBy("unit").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    often = often.where("n > 1" if within else "first < last").select("unit", "first")
    return cut(every.join(often, "unit").withColumn("again", F.lit(within) | (F.col("doc_id") != F.col("first"))), "repeated")


def passages(again: DataFrame, lines: DataFrame) -> DataFrame:
    """The removals of runs of units, beside those of lines(doc_id, line, start, end, word, stop), a table. again: from repeated()."""
    kept = again.where("doc_id = first").groupBy("unit").agg(F.min(F.struct("word", "line")).alias("keep"))
    later = again.where("again").join(kept, "unit").where("doc_id <> first or word <> keep.word").select("doc_id", F.struct("line", "start", "end", "word", "stop", F.col("first").alias("keep_doc_id"), F.col("keep.line").alias("keep_line")).alias("u"))
    by_doc = later.groupBy("doc_id").agg(F.collect_list("u").alias("units"))
    taken = lines.groupBy("doc_id").agg(F.collect_list(F.struct("line", "start", "end", "word", "stop")).alias("lines"))
    return arrow_map(by_doc.join(taken, "doc_id", "left"), _runs, "doc_id long, line int, start long, end long, keep_doc_id long, keep_line int, component long").distinct()
