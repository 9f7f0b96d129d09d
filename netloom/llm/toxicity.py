"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Fitting takes a bounded sample of labelled rows (FIT_ROWS, the first by a hash of the id): a learned lexicon by
log-odds, histogram trees on the driver over the sample's feature rows, calibration on a quarter that the trees
have not seen. Scoring is one pass over all documents: a map without any shuffle, with a model of a few kB.

Defined results: null text counts as empty; empty texts get the model's score of zero features; null ids are scored
(held_out false); repeated rows each get a row; without any label every score is 0.5 (predicted 1 at the 0.5
threshold); with one class only the scores are that class's shrunk rate; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import isotonic, textstats
from .common import arrow_map, fold, forget, texts, training_rows

#: Most labelled rows that the fit reads.
FIT_ROWS = 30_000
FOLDS, HELD, THRESHOLD = 5, 0, 0.5
LEXICON_WORDS, LEXICON_Z, LEXICON_DOCS = 200, 4.0, 8


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: feature and cut of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while at[0] < len(f) if len(at) else False:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - len(f)] if len(at) else 0
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: int = 20) -> Trees:
    """Second-order boosting of the logistic loss on feature histograms."""
    base_rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(base_rate / (1 - base_rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    inner, raw = 2**depth - 1, np.full(len(x), base)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(rows) >= 2 * least:
                gs, hs = g[rows], h[rows]
                total = gs.sum() ** 2 / (hs.sum() + ridge)
                for j, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    k = codes[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(k, w, minlength=len(cut) + 1))[:-1] for w in (gs, hs, None))
                    gain = gl**2 / (hl + ridge) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + ridge) - total
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, float(cut[b]))
            f[node], c[node] = best[1:]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + ridge)
        raw = raw + value[leaf]
        features.append(f)
        thresholds.append(c)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(batch), 0.5)
        x = np.array([textstats.toxicity(t, self.lexicon) for t in batch]).reshape(len(batch), len(textstats.TOXIC_STATS))
        return isotonic.apply(self.knots, self.trees.raw(x))


def _word_counts(batches):
    """Of a partition: in how many toxic and other texts each word stands (summed before the shuffle)."""
    counts: dict[str, list[int]] = {}
    for b in batches:
        for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist()):
            for w in set(textstats.WORD.findall(text.lower())):
                counts.setdefault(w, [0, 0])[y] += 1
    words = list(counts)
    yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "other": pa.array([counts[w][0] for w in words], pa.int64()), "toxic": pa.array([counts[w][1] for w in words], pa.int64())})


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words whose document log-odds for label 1 exceed LEXICON_Z standard errors; at most LEXICON_WORDS, by z then word."""
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}
    odds = lambda c, m: F.log((F.col(c) + 0.5) / (F.lit(float(m)) - F.col(c) + 0.5))
    top = (
        arrow_map(rows.select("text", "y"), _word_counts, "word string, other long, toxic long")
        .groupBy("word").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= LEXICON_DOCS)
        .withColumn("z", (odds("toxic", n[1]) - odds("other", n[0])) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5)))
        .where(F.col("z") >= LEXICON_Z)
        .orderBy(F.desc("z"), "word").limit(LEXICON_WORDS)
    )
    return {r.word: float(r.z) for r in top.collect()}


def _features(batches, lexicon):
    for b in batches:
        x = [textstats.toxicity(t, lexicon) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": b["y"], "part": b["part"], "doc_id": b["doc_id"]})


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    rows = training_rows(docs, labels, "toxic", FOLDS, HELD, bound)
    lexicon = learn_lexicon(rows.where("part <> 0"))
    got = arrow_map(rows, partial(_features, lexicon=lexicon), "x array<double>, y int, part int, doc_id long").toPandas()  # at most `bound` rows of 20 doubles
    forget(rows)
    if got.empty:
        return Model(lexicon, None, isotonic.fit(np.empty(0), np.empty(0)))
    got = got.sort_values("doc_id", kind="stable")
    x, y, part = np.stack(got.x.to_numpy()), got.y.to_numpy(float), got.part.to_numpy()
    own, held = (part != 0, part == 0) if (part == 0).any() and (part != 0).any() else (part >= 0, part >= 0)
    trees = boost(x[own], y[own])
    return Model(lexicon, trees, isotonic.fit(trees.raw(x[held]), y[held]))


def _score(batches, model, threshold):
    for b in batches:
        s = model.scores(b["text"].to_pylist())
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))})


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    out = arrow_map(texts(docs), partial(_score, model=model, threshold=threshold), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", "predicted")
