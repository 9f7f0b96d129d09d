"""Column expressions on array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once for the row, not again for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def centred(x: Column) -> Column:
    return let(x, lambda y: let(total(y) / F.size(y), lambda mean: F.transform(y, lambda v: v - mean)))


def unit(x: Column) -> Column:
    """x over its norm; a zero vector stays."""
    return let(x, lambda y: let(F.sqrt(dot(y, y)), lambda norm: F.transform(y, lambda v: v / F.when(norm > 0, norm).otherwise(1.0))))


def similar(x: Column, kind: str) -> Column:
    """Rows transformed so that their dot product is the similarity: corr, cosim, cov or dot."""
    if kind in ("corr", "cov"):
        x = centred(x)
    if kind in ("corr", "cosim"):
        return unit(x)
    if kind in ("cov", "dot"):
        return let(x, lambda y: let(F.sqrt(F.size(y)), lambda root: F.transform(y, lambda v: v / root)))
    raise ValueError(f"similarity {kind!r}: one of corr, cosim, cov, dot")
