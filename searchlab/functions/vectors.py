"""Native vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def l2_norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def unit_vector(vector: Column) -> Column:
    """Divide by the norm; the zero vector stays zero."""
    norm = l2_norm(vector)
    divisor = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.transform(vector, lambda x: x.cast("double") / divisor)


def leading(vector: Column, dimension: int) -> Column:
    """First ``dimension`` components."""
    if dimension <= 0:
        raise ValueError("dimension must be positive")
    return F.slice(vector, 1, dimension)
