"""Row filters and the cleaning compositions built from them.

The filters are plain predicates, so Catalyst pushes them below the
``distinct`` (an aggregate over all columns) and the shuffle only carries
rows that survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip_text

TRIPLET = ("query_text", "gold_passage", "hard_negative")


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop a row if any (or any of ``subset``) column is null or NaN."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_blank(df: DataFrame, cols: Sequence[str] = ("query_text", "gold_passage")) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~is_blank(c)
    return df.filter(cond)


def within_bounds(bounds: dict[str, tuple[int | None, int | None]]) -> Column:
    """Whether code-point lengths lie in the inclusive bounds; null is open."""
    cond = F.lit(True)
    for c, (lo, hi) in bounds.items():
        n = F.length(c)
        if lo is not None:
            cond = cond & (n >= lo)
        if hi is not None:
            cond = cond & (n <= hi)
    return cond


def length_bounds(df: DataFrame, bounds: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """Keep rows whose code-point lengths lie in the inclusive bounds."""
    return df.filter(within_bounds(bounds))


def row_keys(df: DataFrame) -> list[Column]:
    """256 bits that stand for a whole row where only counts are wanted, so
    that texts need not be shuffled; nulls are told from values."""
    parts = [F.coalesce(F.sha2(F.col(f"`{c}`").cast("string").cast("binary"), 256), F.lit("")) for c in df.columns]
    return [F.unhex(F.sha2(F.concat_ws(",", *parts).cast("binary"), 256)).alias("_row")]


def drop_identical_negative(df: DataFrame, gold: str = "gold_passage",
                            negative: str = "hard_negative") -> DataFrame:
    return df.filter(~F.col(negative).eqNullSafe(F.col(gold)))


DEFAULT_BOUNDS = {"query_text": (10, 512), "gold_passage": (20, 2048)}


def _clean_flags(df: DataFrame, bounds: dict, negative: str | None) -> list[tuple[str, Column]]:
    """Cumulative row-wise keep flags of the cleaning steps after distinct."""
    not_null = F.lit(True)
    for c in df.columns:
        not_null = not_null & F.col(c).isNotNull()
    blank_ok = ~is_blank("query_text") & ~is_blank("gold_passage")
    len_ok = within_bounds(bounds)
    ident_ok = ~F.col(negative).eqNullSafe(F.col("gold_passage")) if negative else F.lit(True)
    return [("not_null", not_null), ("non_blank", blank_ok), ("length", len_ok),
            ("not_identical", ident_ok)]


def clean_dataset(df: DataFrame, bounds: dict | None = None,
                  negative: str | None = "hard_negative") -> DataFrame:
    """nulls -> duplicates -> blank query/gold -> length bounds -> negative
    equal to gold.  ``negative=None`` (or a frame without that column) skips
    the last step."""
    bounds = bounds or DEFAULT_BOUNDS
    if negative and negative not in df.columns:
        negative = None
    out = drop_nulls(df)
    out = drop_blank(out)
    out = length_bounds(out, bounds)
    if negative:
        out = drop_identical_negative(out, negative=negative)
    return out.distinct()


def retention_report(df: DataFrame, bounds: dict | None = None,
                     negative: str | None = "hard_negative") -> DataFrame:
    """Row count after each step of :func:`clean_dataset`, with % of input.

    One shuffle: rows are grouped to distinct rows with their multiplicity, by
    a hash of the row and its flags, so no text is moved; the flags are then
    summed.  Empty input gives null percentages.
    """
    bounds = bounds or DEFAULT_BOUNDS
    if negative and negative not in df.columns:
        negative = None
    given = _clean_flags(df, bounds, negative)
    g = df.groupBy(*row_keys(df), *[f.alias(f"_{name}") for name, f in given]).agg(F.count(F.lit(1)).alias("_m"))
    flags = [(name, F.col(f"_{name}")) for name, _ in given]
    keep = flags[0][1]
    aggs = [F.sum("_m").alias("input"),
            F.sum(F.when(keep, F.col("_m"))).alias("not_null"),
            F.count_if(keep).alias("distinct")]
    for name, f in flags[1:]:
        keep = keep & f
        aggs.append(F.count_if(keep).alias(name))
    one = g.agg(*aggs)
    steps = ["input", "not_null", "distinct"] + [n for n, _ in flags[1:]]
    stack = ", ".join(f"{i}, '{s}', cast(coalesce(`{s}`, 0) as bigint)" for i, s in enumerate(steps))
    long = one.selectExpr("input as _in", f"stack({len(steps)}, {stack}) as (step_no, step, rows)")
    return long.select(
        F.col("step_no").cast("int"), "step", "rows",
        F.round(F.try_divide(F.col("rows") * F.lit(100.0), F.col("_in").cast("double")), 6)
        .alias("retained_pct"))


def preprocess_training(df: DataFrame, min_query_len: int = 5,
                        max_passage_len: int = 2048) -> DataFrame:
    """nulls -> strip the three text columns -> non-empty -> query length
    floor -> passage length ceiling -> negative differs from gold.  No
    de-duplication."""
    out = drop_nulls(df)
    for c in TRIPLET:
        out = out.withColumn(c, strip_text(c))
    out = out.filter((F.length("query_text") > 0) & (F.length("gold_passage") > 0)
                     & (F.length("hard_negative") > 0))
    out = out.filter(F.length("query_text") >= min_query_len)
    out = out.filter((F.length("gold_passage") <= max_passage_len)
                     & (F.length("hard_negative") <= max_passage_len))
    return out.filter(F.col("gold_passage") != F.col("hard_negative"))


def training_stats(df: DataFrame) -> DataFrame:
    """Row count and average code-point lengths of a triplet table."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.round(F.avg(F.length(c)), 6).alias(f"avg_{c}_len") for c in TRIPLET])


def keep_hard(df: DataFrame, flag: str = "is_hard") -> DataFrame:
    """Rows graded hard (null = not graded = excluded), triplet columns."""
    return df.filter(F.col(flag) == F.lit(True)).select(*TRIPLET)


def skip_missing_inputs(df: DataFrame, query: str, negative: str, on_error: str = "label") -> Column | DataFrame:
    """Rows whose query or negative is empty: ``label`` keeps them (the
    caller labels them ``unknown``), ``drop`` removes them."""
    missing = (F.coalesce(F.col(query), F.lit("")) == "") | (F.coalesce(F.col(negative), F.lit("")) == "")
    if on_error == "drop":
        return df.filter(~missing)
    return df.withColumn("_missing_input", missing)
