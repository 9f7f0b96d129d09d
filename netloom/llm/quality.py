"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration.

cos(Wx + b) with Gaussian W approximates a Gaussian kernel over the standardised statistics. Each partition of the
fitting rows sends one Gram matrix (DIMS x DIMS) and one right-hand side; FIT_PARTS bounds how many there are.
The fit reads a bounded sample of labelled rows (FIT_ROWS, the first by a hash of the id). Scoring is one pass without a shuffle.

Defined results: null text counts as empty; empty texts get the score of zero statistics; null ids are scored (held_out
false); repeated rows each get a row; without labels every score is 0.5 (predicted 0 at the 0.7 threshold), except that
the filter then keeps all; extra columns are ignored by score() and passed on by keep().
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import isotonic, textstats
from .common import arrow_map, cut, fold, forget, texts, training_rows

#: Most labelled rows that the fit reads.
FIT_ROWS = 30_000
FOLDS, HELD, THRESHOLD = 4, 2, 0.7
DIMS, RIDGE, SEED, FIT_PARTS = 256, 1.0, 7, 16


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return np.concatenate([np.sqrt(2 / self.w.shape[1]) * np.cos(z), np.ones((len(x), 1))], 1)

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(batch), 0.5)
        x = np.array([textstats.quality(t) for t in batch]).reshape(len(batch), len(textstats.QUALITY_STATS))
        return isotonic.apply(self.knots, self.lift(x) @ self.beta)


def _stats(batches):
    for b in batches:
        x = [textstats.quality(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": b["y"], "part": b["part"]})


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b["x"].flatten().to_numpy().reshape(len(b), -1)


def _moments(batches):
    n, s, q = 0, 0.0, 0.0
    for b in batches:
        x = _matrix(b)
        n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "s": pa.array([s], pa.list_(pa.float64())), "q": pa.array([q], pa.list_(pa.float64()))})


def _normal(batches, model):
    """One Gram matrix and right-hand side for the partition."""
    a = r = None
    for b in batches:
        z, y = model.lift(_matrix(b)), b["y"].to_numpy().astype(float)
        a, r = (z.T @ z, z.T @ y) if a is None else (a + z.T @ z, r + z.T @ y)
    if a is not None:
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "r": [r.tobytes()]})


def _raw(batches, model):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"raw": model.lift(_matrix(b)) @ model.beta, "y": b["y"]})


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    rows = training_rows(docs, labels, "quality", FOLDS, HELD, bound)
    stats = cut(arrow_map(rows, _stats, "x array<double>, y int, part int").repartition(FIT_PARTS), "stats")
    forget(rows)
    none = isotonic.fit(np.empty(0), np.empty(0))
    d = len(textstats.QUALITY_STATS)
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / np.sqrt(d / 2), (d, DIMS)), rng.uniform(0, 2 * np.pi, DIMS)
    own = stats.where("part <> 0")
    moments = arrow_map(own, _moments, "n long, s array<double>, q array<double>").collect()
    if not moments:
        own = stats
        moments = arrow_map(own, _moments, "n long, s array<double>, q array<double>").collect()
    if not moments:
        forget(stats)
        return Model(np.zeros(d), np.ones(d), w, b, None, none)
    n = sum(m.n for m in moments)
    mean = sum(np.array(m.s) for m in moments) / n
    scale = np.sqrt(np.maximum(sum(np.array(m.q) for m in moments) / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, b, None, none)
    sums = arrow_map(own, partial(_normal, model=model), "a binary, r binary").collect()  # FIT_PARTS rows at most
    a = sum(np.frombuffer(s.a).reshape(DIMS + 1, DIMS + 1) for s in sums)
    r = sum(np.frombuffer(s.r) for s in sums)
    beta = np.linalg.solve(a + RIDGE * np.eye(DIMS + 1), r)
    model = Model(model.mean, model.scale, w, b, beta, none)
    held = arrow_map(stats.where("part = 0"), partial(_raw, model=model), "raw double, y int").toPandas()
    if held.empty:
        held = arrow_map(own, partial(_raw, model=model), "raw double, y int").toPandas()
    forget(stats)
    return Model(model.mean, model.scale, w, b, beta, isotonic.fit(held.raw.to_numpy(), held.y.to_numpy(float)))


def _score(batches, model, threshold):
    for b in batches:
        s = model.scores(b["text"].to_pylist())
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))})


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    out = arrow_map(texts(docs), partial(_score, model=model, threshold=threshold), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", "predicted")


def _keep(batches, model, threshold, text):
    for b in batches:
        s = model.scores([t or "" for t in b[text].to_pylist()])
        yield b.filter(pc.greater_equal(pa.array(s), threshold))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns; all rows where there was nothing to learn from."""
    return docs if model.beta is None else arrow_map(docs, partial(_keep, model=model, threshold=threshold, text=text), docs.schema)
