"""Array-of-double vector expressions (Spark has no built-in vector maths
on array columns, so these are higher-order array functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_vector(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v * v))


def normalize_vector(a, eps: float = 0.0) -> Column:
    """``a / (||a|| + eps)``; with ``eps == 0`` an all-zero vector stays zero.
    Vector and norm are bound once a row: inside the loop over the numbers
    they would be computed again for each of them."""
    once = F.transform(F.array(_c(a)), lambda v: F.struct(v.alias("v"), (l2_norm(v) + F.lit(eps)).alias("n")))
    return F.get(F.transform(once, lambda s: F.transform(
        s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(F.lit(0.0)))), F.lit(0))


def cosine(a, b, eps: float = 1e-8) -> Column:
    """``dot(a, b) / (||a|| * ||b|| + eps)``."""
    return dot(a, b) / (l2_norm(a) * l2_norm(b) + F.lit(eps))


def slice_dims(a, start: int, length: int) -> Column:
    """Sub-vector of ``length`` dimensions from 1-based ``start``."""
    return F.slice(_c(a), start, length)
