"""Isotonic calibration by pool-adjacent-violators."""

from __future__ import annotations

import numpy as np


def fit(raw: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, p) of a monotone map from raw scores to probabilities.

    Ties in raw are pooled first. Each block is shrunk by `weight` pseudo-rows to the base rate, so that no block says 0 or 1 flat.
    With no rows at all the map is the constant 0.5.
    """
    if not len(raw):
        return np.array([0.0]), np.array([0.5])
    base = float(y.mean())
    x, at = np.unique(raw, return_inverse=True)
    n, s = np.bincount(at).astype(float), np.bincount(at, weights=y)
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for xi, ni, si in zip(x, n, s):
        blocks.append([si, ni, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            si2, ni2, _, last = blocks.pop()
            blocks[-1][0] += si2
            blocks[-1][1] += ni2
            blocks[-1][3] = last
    knots, p = [], []
    for si, ni, lo, hi in blocks:
        v = (si + weight * base) / (ni + weight)
        for xi in ([lo] if lo == hi else [lo, hi]):
            knots.append(xi)
            p.append(v)
    return np.array(knots), np.maximum.accumulate(np.array(p))


def apply(knots: tuple[np.ndarray, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """Probabilities, linear between blocks; a small share of the raw rank keeps order inside a flat block."""
    x, p = knots
    out = np.interp(raw, x, p)
    return np.clip(out + 1e-6 * np.tanh(raw), 0.0, 1.0)
