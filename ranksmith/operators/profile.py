"""Profiling aggregates over triplet, score and evaluation tables.

Whole-table profiles are single global aggregations (partial aggregation per
partition, one small merge); per-group profiles are ``groupBy`` on
low-cardinality keys (setting, language, label).  Exact percentiles keep a
value->count map per group, so their memory grows with the number of
distinct values (small for lengths and parsed scores); ``approx=True``
switches to ``percentile_approx`` for unbounded domains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .quantiles import exact_percentiles

from .clean import TRIPLET, row_keys


def _pct(c, q: float, approx: bool) -> Column:
    return F.percentile_approx(c, q, 100000) if approx else F.percentile(c, q)


def _stack(one: DataFrame, names: Sequence[str], fields: Sequence[str], key: str = "column") -> DataFrame:
    """Reshape a one-row frame with ``{name}__{field}`` columns into one row
    per name."""
    parts = ", ".join(f"'{n}', " + ", ".join(f"`{n}__{f}`" for f in fields) for n in names)
    return one.selectExpr(f"stack({len(names)}, {parts}) as ({key}, {', '.join(fields)})")


def length_profile(df: DataFrame, cols: Sequence[str] = TRIPLET, approx: bool = False) -> DataFrame:
    """Per text column: mean, median, sample std, min, max, q25, q75 of the
    code-point lengths (nulls skipped)."""
    cols = [c for c in cols if c in df.columns]
    aggs = []
    for c in cols:
        n = F.length(c)
        aggs += [F.avg(n).alias(f"{c}__mean"), _pct(n, 0.5, approx).cast("double").alias(f"{c}__median"),
                 F.stddev_samp(n).alias(f"{c}__std"), F.min(n).cast("long").alias(f"{c}__min"),
                 F.max(n).cast("long").alias(f"{c}__max"),
                 _pct(n, 0.25, approx).cast("double").alias(f"{c}__q25"),
                 _pct(n, 0.75, approx).cast("double").alias(f"{c}__q75")]
    return _stack(df.agg(*aggs), cols, ["mean", "median", "std", "min", "max", "q25", "q75"])


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column and in total (``*``), with % of rows; one global
    aggregation reshaped to one row per column."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in df.columns]
    one = df.agg(*aggs)
    one = one.withColumn("*__nulls", sum((F.col(f"`{c}__nulls`") for c in df.columns), F.lit(0)))
    names = [*df.columns, "*"]
    parts = ", ".join(f"'{n}', `{n}__nulls`" for n in names)
    long = one.selectExpr("_rows", f"stack({len(names)}, {parts}) as (column, nulls)")
    return long.select(
        "column", F.col("nulls").cast("long").alias("nulls"),
        F.try_divide(F.col("nulls") * F.lit(100.0), F.col("_rows").cast("double")).alias("null_pct"))


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (null-safe), and their share."""
    g = df.groupBy(*row_keys(df)).agg(F.count(F.lit(1)).alias("_m"))
    return g.agg(F.sum("_m").cast("long").alias("rows"),
                 F.sum(F.col("_m") - 1).cast("long").alias("duplicates")) \
        .withColumn("dup_pct", F.try_divide(F.col("duplicates") * F.lit(100.0), F.col("rows").cast("double")))


def identical_pair_count(df: DataFrame, gold: str = "gold_passage", negative: str = "hard_negative") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col(gold) == F.col(negative)).alias("identical")) \
        .withColumn("identical_pct", F.try_divide(F.col("identical") * F.lit(100.0), F.col("rows").cast("double")))


def short_long_counts(df: DataFrame, short_query: int = 10, long_passage: int = 2000) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.length("query_text") < short_query).alias("short_queries"),
                  F.count_if(F.length("gold_passage") > long_passage).alias("long_gold"),
                  F.count_if(F.length("hard_negative") > long_passage).alias("long_negative"))


RATIOS = ("qg", "qn", "gn")


def length_ratio_profile(df: DataFrame, group: Sequence[str] = ("lang",), approx: bool = False) -> DataFrame:
    """Mean and median of query/gold, query/negative, gold/negative length
    ratios per group (division by zero -> null, skipped)."""
    from ..functions.text import length_ratio
    r = df.select(*group, length_ratio("query_text", "gold_passage").alias("qg"),
                  length_ratio("query_text", "hard_negative").alias("qn"),
                  length_ratio("gold_passage", "hard_negative").alias("gn"))
    means = [F.avg(c).alias(f"{c}_mean") for c in RATIOS]
    if approx:
        return _ordered(r.groupBy(*group).agg(*means, *[_pct(F.col(c), 0.5, True).alias(f"{c}_median") for c in RATIOS]), group)
    # Ratios are nearly unique, so the exact median comes from value histograms.
    long = staged(r.select(*group, F.explode(F.array(*[F.struct(F.lit(c).alias("_ratio"), F.col(c).alias("_x")) for c in RATIOS])).alias("e"))
                  .select(*group, "e.*"), "ratios")
    mid = exact_percentiles(long, [*group, "_ratio"], "_x", [0.5])
    rows = long.groupBy(*group, "_ratio").agg(F.avg("_x").alias("_mean"), F.lit(None).cast("double").alias("_median")).unionByName(
        mid.select(*group, "_ratio", F.lit(None).cast("double").alias("_mean"), F.col("value").alias("_median")))
    pick = [F.max(F.when(F.col("_ratio") == c, F.col(f"_{what}"))).alias(f"{c}_{what}") for c in RATIOS for what in ("mean", "median")]
    return rows.groupBy(*group).agg(*pick)


def _ordered(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.select(*group, *[f"{c}_{what}" for c in RATIOS for what in ("mean", "median")])


def length_histogram(df: DataFrame, cols: Sequence[str] = TRIPLET, bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins between min and max length per column (last
    bin closed) with counts and density ``count / (n * width)``."""
    cols = [c for c in cols if c in df.columns]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.length(c).alias("len"))
                                         for c in cols])).alias("x")).select("x.*") \
        .filter(F.col("len").isNotNull())
    rng = long.groupBy("column").agg(F.min("len").alias("mn"), F.max("len").alias("mx"),
                                      F.count(F.lit(1)).alias("n"))
    j = long.join(F.broadcast(rng), "column")  # one row per column: bounded
    width = (F.col("mx") - F.col("mn")).cast("double") / F.lit(float(bins))
    b = F.when(F.col("mx") == F.col("mn"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("len") - F.col("mn")) * F.lit(float(bins)) / (F.col("mx") - F.col("mn"))),
                F.lit(bins - 1)) + 1)
    h = j.withColumn("bin", b.cast("int")).groupBy("column", "bin", "mn", "mx", "n").agg(
        F.count(F.lit(1)).alias("count"))
    return h.select("column", "bin",
                    (F.col("mn") + (F.col("bin") - 1) * width).alias("lo"),
                    (F.col("mn") + F.col("bin") * width).alias("hi"),
                    "count",
                    F.try_divide(F.col("count").cast("double"), F.col("n") * width).alias("density"))


def score_distribution(df: DataFrame, score: str = "rag_score", approx: bool = False) -> DataFrame:
    s = F.col(score)
    return df.agg(F.count(s).alias("count"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"),
                  F.min(s).alias("min"), F.max(s).alias("max"), _pct(s, 0.5, approx).alias("median"))


def score_bands(df: DataFrame, score: str = "rag_score", hard: float = 0.6, easy: float = 0.4) -> DataFrame:
    """hard > 0.6, medium 0.4..0.6 inclusive, easy < 0.4: count and %."""
    s = F.col(score)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 F.count_if(s > hard).alias("hard"),
                 F.count_if((s >= easy) & (s <= hard)).alias("medium"),
                 F.count_if(s < easy).alias("easy"))
    long = one.selectExpr("_n", "stack(3, 'hard_gt_0.6', hard, 'medium_0.4_0.6', medium, "
                                "'easy_lt_0.4', easy) as (band, count)")
    return long.select("band", "count",
                       F.try_divide(F.col("count") * F.lit(100.0), F.col("_n").cast("double")).alias("pct"))


def class_counts(df: DataFrame, label: str = "llm_classification", score: str = "hardness_score") -> DataFrame:
    """Per label: count, % of all rows, mean score.  The total is a window
    over the grouped result (one row per label)."""
    from pyspark.sql import Window
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"), F.avg(score).alias("mean_score"))
    return g.select(label, "count", "mean_score",
                    (F.col("count") * F.lit(100.0) / F.sum("count").over(Window.partitionBy())).alias("pct"))


def eval_validation(df: DataFrame, group: Sequence[str] = ("setting", "lang")) -> DataFrame:
    """Per group: nulls over all columns, empty queries, empty passages,
    and whether the group is clean."""
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("samples"), F.sum(nulls).alias("nulls"),
                               F.count_if(F.length("query") == 0).alias("empty_queries"),
                               F.count_if(F.length("passage") == 0).alias("empty_passages"))
    return g.withColumn("clean", (F.col("nulls") == 0) & (F.col("empty_queries") == 0)
                        & (F.col("empty_passages") == 0))


def dataset_summary(df: DataFrame, group: Sequence[str] = ("setting", "lang")) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.length("query")).alias("avg_query_len"),
        F.avg(F.length("passage")).alias("avg_passage_len"),
        F.min(F.length("passage")).cast("long").alias("min_passage_len"),
        F.max(F.length("passage")).cast("long").alias("max_passage_len"))


def dataset_counts(df: DataFrame, group: Sequence[str] = ("setting", "lang")) -> DataFrame:
    """Counts per (setting, lang), per setting and overall (``rollup``; the
    rolled-up levels have null keys)."""
    return df.rollup(*group).agg(F.count(F.lit(1)).alias("rows"))


def selection_metadata(scored: DataFrame, threshold: float, score: str = "rag_score",
                       p: float = 0.5) -> DataFrame:
    """One record: totals, % selected, threshold, score stats and bands --
    a single aggregation over the scored table."""
    s = F.col(score)
    return scored.agg(
        F.count(F.lit(1)).alias("total_negatives"),
        F.count_if(s >= F.lit(threshold)).alias("selected_negatives"),
        F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"),
        F.max(s).alias("max"), F.percentile(s, 0.5).alias("median"),
        F.count_if(s > 0.6).alias("hard_gt_0_6"),
        F.count_if((s >= 0.4) & (s <= 0.6)).alias("medium_0_4_0_6"),
        F.count_if(s < 0.4).alias("easy_lt_0_4")).select(
        "total_negatives", "selected_negatives",
        F.try_divide(F.col("selected_negatives") * F.lit(100.0), F.col("total_negatives").cast("double"))
        .alias("selection_percentage"),
        F.lit(p).alias("quality_percentile"), F.lit(threshold).cast("double").alias("score_threshold"),
        "mean", "std", "min", "max", "median", "hard_gt_0_6", "medium_0_4_0_6", "easy_lt_0_4")
