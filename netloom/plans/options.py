"""Validated options of the iterative operators."""

from __future__ import annotations

from dataclasses import dataclass

OBJECTIVES = ("kmeans", "kmodularity", "kmodularity_ctr", "modularity", "modularity_ctr", "spectral")
SIMILARITIES = ("network", "corr", "cosim", "cov", "dot")
STARTS = ("greedy", "balanced", "random")


@dataclass(frozen=True)
class Climb:
    """numbatches None: 10, or n where there are fewer nodes."""

    start: object = "greedy"
    numbatches: int | None = None
    maxiter: int = 1000
    replicates: int = 10
    tolerance: float = 1e-10
    seed: int = 1

    def __post_init__(self):
        if isinstance(self.start, str) and self.start not in STARTS:
            raise ValueError(f"start: one of {', '.join(STARTS)}, or labels")
        if min(self.maxiter, self.replicates) < 1 or self.tolerance <= 0:
            raise ValueError("maxiter, replicates and tolerance must be positive")

    def batches(self, n: int) -> int:
        if self.numbatches is None:
            return min(10, n)
        if not 1 <= self.numbatches <= n:
            raise ValueError("numbatches must be between 1 and the number of nodes")
        return self.numbatches


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name}: one of {', '.join(allowed)}")
    return value
