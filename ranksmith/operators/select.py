"""Quantile-threshold selection of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_percentiles


def quantile_threshold(df: DataFrame, score: str = "rag_score", p: float = 0.5,
                       approx: bool = False) -> float | None:
    """The ``1 - p`` quantile of ``score`` with linear interpolation (the
    pandas / ``quantile_cont`` definition), from nested value histograms: one
    row comes back to the driver.  ``approx`` uses ``percentile_approx``."""
    q = 1.0 - p
    if approx:
        return df.agg(F.percentile_approx(score, q, 100000).alias("t")).first()["t"]
    found = exact_percentiles(df, [], score, [q]).first()
    return found["value"] if found else None


def threshold_select(df: DataFrame, threshold: float | None, score: str = "rag_score") -> DataFrame:
    """Rows with ``score >= threshold`` (ties kept)."""
    if threshold is None:
        return df.limit(0)
    return df.filter(F.col(score) >= F.lit(threshold))


def select_top_fraction(df: DataFrame, p: float = 0.5, score: str = "rag_score",
                        tie_cols=("query_text", "hard_negative"), approx: bool = False,
                        sort: bool = True) -> tuple[DataFrame, float | None]:
    """Keep the top ``p`` share by score: threshold at quantile ``1-p``, keep
    ``>=`` (ties kept), sorted descending with a total order."""
    t = quantile_threshold(df, score, p, approx)
    out = threshold_select(df, t, score)
    if sort:
        out = out.orderBy(F.col(score).desc(), *[F.col(c).asc() for c in tie_cols])
    return out, t
