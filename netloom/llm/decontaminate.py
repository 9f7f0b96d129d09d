"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND with every passage.

The index is the small side: items are a stated query set, in shards of SHARD_ITEMS that are shipped to the tasks; documents
are never shuffled. A term's weight in an item is its BM25 contribution over the item's score with itself, so
the threshold means "this share of the item". Passages are two adjacent segments of SEGMENT words, one segment apart, over whole texts.

Search of a passage, all exact bounds: the sum of its terms' greatest weights in each block of items (block-max) must reach the
threshold; in blocks that pass, items are visited in order by WAND pivots, skipping to the first item whose terms' upper bounds
reach the threshold, and scored. All items at or above the threshold are returned; none is cut off. A found item
is verified: at least OVERLAP of the 5-word shingles of its question (the first three quarters) and of its answer (the rest) stand near the passage.

An item longer than a passage is indexed as pieces of PIECE words at most, each searched and verified (as a whole) as an item of its own, anywhere
in a text. The item is found if its pieces' shingle overlaps, weighted by the words of question and answer in them, reach OVERLAP for both. Its score is
the pieces' mean, by words, and start_word the first piece's.

Defined results: null text counts as empty and has no passages; null items are left out; items whose text is repeated are found
each; null doc ids are reported with null; repeated rows are reported once; of an id's several texts the one with the best score, then the
first place, is reported; an empty table or benchmark gives an empty result;
extra columns are ignored by search() and passed on by keep().
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, texts, without

WORDS = re.compile(r"\w+")
K1, B = 1.2, 0.75
SHARD_ITEMS, BLOCKS, SEGMENT, THRESHOLD, OVERLAP, WIDTH = 4096, 32, 32, 0.5, 0.6, 5
PIECE = 48
SCHEMA = "doc_id long, item_id long, score double, question double, answer double, start_word long"


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams(w: list[str], k: int = WIDTH) -> set[tuple[str, ...]]:
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


@dataclass
class Index:
    ids: list[int]
    vocabulary: dict[str, int]
    postings: list[list[tuple[int, float]]]  # by term: (item, weight) in order of items
    top: np.ndarray  # term x block: the greatest weight; the last row is for unknown words
    per_block: int
    parts: list[tuple[list[str], list[str]]]  # question and answer words
    shares: list[tuple[int, float, float]]  # number of the whole item, share of its question and answer words; a whole item has 1 and 1

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that reach the threshold with these distinct known terms."""
        out = []
        for block in np.flatnonzero(self.top[terms].sum(0) >= threshold - 1e-9):
            out += self._wand(terms[self.top[terms, block] > 0], int(block), threshold)
        return out

    def _wand(self, terms, block: int, threshold: float) -> list[tuple[int, float]]:
        low, high = block * self.per_block, (block + 1) * self.per_block
        cursors = []  # [item, upper bound, place, posting list]
        for t in terms:
            mine = [x for x in self.postings[t] if low <= x[0] < high]
            cursors.append([mine[0][0], float(self.top[t, block]), 0, mine])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[1]
                if bound >= threshold - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                return out
            if cursors[0][0] == pivot:
                score = sum(c[3][c[2]][1] for c in cursors if c[0] == pivot)
                if score >= threshold - 1e-9:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            rest = []
            for c in cursors:
                while c[2] < len(c[3]) and c[3][c[2]][0] < target:
                    c[2] += 1
                if c[2] < len(c[3]):
                    c[0] = c[3][c[2]][0]
                    rest.append(c)
            cursors = rest
        return out


def _alike(x: tuple[int, list[str]], df: dict[str, int]):
    return max(x[1], key=lambda t: (df[t], t)), len(x[1]), x[0]


def _cut_at(n: int) -> int:
    """Words of the question of an item of n words."""
    return max(1, n - max(min(3, n - 1), n // 4))


def pieces(split: list[tuple[int, list[str]]]) -> tuple[list[tuple[int, list[str]]], list[tuple[int, float, float]]]:
    """The items, those longer than a passage in pieces, and of each its Index.shares."""
    out, shares = [], []
    for number, (i, w) in enumerate(split):
        n = 1 if len(w) <= 2 * SEGMENT else math.ceil(len(w) / PIECE)
        question = _cut_at(len(w))
        for k in range(n):
            lo, hi = k * len(w) // n, (k + 1) * len(w) // n
            out.append((i, w[lo:hi]))
            in_question = max(0, min(hi, question) - lo)
            shares.append((number, 1, 1) if n == 1 else (number, in_question / question, (hi - lo - in_question) / (len(w) - question)))
    return out, shares


@dataclass
class Statistics:
    """Of all items of a benchmark: how many there are, their pieces and words, and in how many each word stands."""

    df: dict[str, int] = field(default_factory=dict)
    items: int = 0
    pieces: int = 0
    words: int = 0

    def add(self, items: list[tuple[int, str]]) -> Statistics:
        split = [(i, w) for i, t in items if t and (w := words(t))]
        for _, w in split:
            for x in set(w):
                self.df[x] = self.df.get(x, 0) + 1
            self.words += len(w)
        self.items, self.pieces = self.items + len(split), self.pieces + len(pieces(split)[0])
        return self


def build(items: list[tuple[int, str]], blocks: int = BLOCKS, of: Statistics | None = None) -> list[Index]:
    """Shards of the index. Document frequencies and the average length are of all items (`of`, or these), so that shards and parts do not change scores."""
    of = of or Statistics().add(items)
    df = of.df
    split, whole_of = pieces([(i, w) for i, t in items if t and (w := words(t))])
    idf = {x: math.log(1 + (of.items - df[x] + 0.5) / (df[x] + 0.5)) for x in {x for _, w in split for x in w}}
    mean = of.words / max(1, of.pieces)
    whole_of = [x for _, x in sorted(zip(split, whole_of), key=lambda x: _alike(x[0], df))]
    split.sort(key=lambda x: _alike(x, df))  # alike items share blocks
    out = []
    for s in range(0, len(split), SHARD_ITEMS):
        part = split[s : s + SHARD_ITEMS]
        vocabulary = {x: k for k, x in enumerate(sorted({x for _, w in part for x in w}))}
        per_block = math.ceil(len(part) / blocks)
        postings: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        top = np.zeros((len(vocabulary) + 1, math.ceil(len(part) / per_block)), np.float64)
        for i, (_, w) in enumerate(part):
            tf: dict[str, int] = {}
            for x in w:
                tf[x] = tf.get(x, 0) + 1
            weight = {x: idf[x] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for x, n in tf.items()}
            whole = sum(weight.values())
            for x, v in weight.items():
                t = vocabulary[x]
                postings[t].append((i, v / whole))
                top[t, i // per_block] = max(top[t, i // per_block], v / whole)
        own = whole_of[s : s + SHARD_ITEMS]
        cut_at = [_cut_at(len(w)) if x[1:] == (1, 1) else len(w) for (_, w), x in zip(part, own)]
        out.append(Index([i for i, _ in part], vocabulary, postings, top, per_block, [(w[:c], w[c:]) for (_, w), c in zip(part, cut_at)], own))
    return out


def find(text: str, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float, int]]:
    """Of one whole text: item -> (score, question overlap, answer overlap, first word of the passage), the best passage of each verified item."""
    w = words(text)
    known = index.vocabulary.get
    terms = np.fromiter((known(x, -1) for x in w), np.int64, len(w))
    at = np.flatnonzero(terms >= 0)
    if not len(at):
        return {}
    size = len(index.vocabulary) + 1
    pairs = np.unique(at // SEGMENT * size + terms[at])  # distinct terms of each segment
    seg, term = pairs // size, pairs % size
    kinds, first = np.unique(seg, return_index=True)
    sums = np.zeros((len(w) // SEGMENT + 2, index.top.shape[1]))
    sums[kinds] = np.add.reduceat(index.top[term], first, axis=0)
    passages = np.flatnonzero(((sums[:-1] + sums[1:]) >= threshold - 1e-9).any(1))
    out: dict[int, tuple[float, float, float, int]] = {}
    for p in passages:
        own = np.unique(term[np.searchsorted(seg, p) : np.searchsorted(seg, p + 2)])
        for item, score in index.search(own, threshold):
            near = grams(w[max(0, (p - 1) * SEGMENT) : (p + 3) * SEGMENT])
            shares = []
            for part in index.parts[item]:
                g = grams(part)
                have = near if len(part) >= WIDTH else grams(w[max(0, (p - 1) * SEGMENT) : (p + 3) * SEGMENT], len(part))
                shares.append(len(g & have) / len(g) if g else 1.0)
            if min(shares) >= overlap and (item not in out or (score, -p) > (out[item][0], -out[item][3])):
                out[item] = (float(score), *shares, int(p))
    return out


def _search(batches, shards, threshold, overlap):
    for b in batches:
        rows = []
        for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            long: dict[int, list] = {}
            for index in shards:
                for item, (score, q, a, p) in find(text, index, threshold, overlap).items():
                    number, in_question, in_answer = index.shares[item]
                    if (in_question, in_answer) == (1, 1):
                        rows.append((i, index.ids[item], score, q, a, p * SEGMENT))
                    else:
                        long.setdefault(number, []).append((index.ids[item], score, q * in_question, q * in_answer, p * SEGMENT, len(index.parts[item][0])))
            for found in long.values():
                q, a = (sum(x[k] for x in found) for k in (2, 3))
                if min(q, a) >= overlap - 1e-9:
                    rows.append((i, found[0][0], sum(x[1] * x[5] for x in found) / sum(x[5] for x in found), q, a, min(x[4] for x in found)))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "score", "question", "answer", "start_word"])


#: Most characters of benchmark items that one index may hold (some 200 MB in a worker); a larger benchmark is searched in parts, each with all documents.
INDEX_CHARS = 8_000_000


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question, answer, start_word): every verified item of every document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n = max(1, math.ceil(chars / INDEX_CHARS))
    part = lambda k: [(r.item_id, r.text) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)).orderBy("item_id", "text").collect()]
    of, out = Statistics(), None
    for k in range(n):
        of.add(part(k))
    for k in range(n):  # bounded parts of the query set, each against all documents
        found = arrow_map(texts(docs), partial(_search, shards=build(part(k), of=of), threshold=threshold, overlap=overlap), SCHEMA)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("back"), "question", "answer"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", "b.question", "b.answer", (-F.col("b.back")).alias("start_word"))


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item."""
    return without(docs, cut(search(docs, benchmark).where("doc_id is not null").select("doc_id").distinct(), "leaks"))
