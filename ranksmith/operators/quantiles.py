"""Exact order statistics of large groups.

Spark's ``percentile`` holds a map of a group's distinct values in one task,
which near-unique values make as large as the group.  Here each wanted rank
has an interval that holds it, at first from the group's least to its largest
value.  A round counts the interval's values in ``BUCKETS`` equal parts, by
partial sums, and only the part with the wanted rank is looked at again, until
it holds one distinct value or few enough rows to sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

BUCKETS = 1024
#: Rows of an interval that are sorted at once.
SORTED_ROWS = 4096


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for c in keys:  # a null key is a group like any other
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, ps: Sequence[float],
                      buckets: int = BUCKETS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """``(group..., p, value)``: percentiles with linear interpolation, as
    ``percentile`` gives them.  Nulls and NaN are passed over; groups without
    a value have no row."""
    keys = [f"_g{i}" for i in range(len(group))]
    v = staged(df.select(*[F.col(c).alias(k) for c, k in zip(group, keys)], F.col(value).cast("double").alias("_v"))
               .filter(F.col("_v").isNotNull() & ~F.isnan("_v")), "values")
    stats = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("_n > 0")
    at = F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")
    spots = stats.select(*keys, "_n", "_lo", "_hi", at).withColumn("_at", F.col("p") * (F.col("_n") - 1))
    spots = staged(spots.withColumns({"_r0": F.floor("_at"), "_r1": F.ceil("_at")}), "spots")
    ranks = spots.select(*keys, "_lo", "_hi", F.col("_n").alias("_held"), F.explode(F.array("_r0", "_r1")).alias("_rank")).distinct()
    state = staged(ranks.withColumn("_before", F.lit(0).cast("long")), "ranks")
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_held") > sorted_rows)
    interval = [*keys, "_lo", "_hi", "_before"]
    while not state.filter(wide).isEmpty():
        spans = state.filter(wide).select(*interval).distinct()
        part = F.least(F.floor((F.col("v._v") - F.col("s._lo")) / (F.col("s._hi") - F.col("s._lo")) * buckets), F.lit(buckets - 1))
        counts = (v.alias("v").join(spans.alias("s"), _same(keys, "v", "s") & F.col("v._v").between(F.col("s._lo"), F.col("s._hi")))
                  .groupBy(*[F.col(f"s.{c}").alias(c) for c in interval], part.alias("_part"))
                  .agg(F.count(F.lit(1)).alias("_c"), F.min("v._v").alias("_least"), F.max("v._v").alias("_most")))
        upto = F.sum("_c").over(Window.partitionBy(*interval).orderBy("_part")) + F.col("_before")
        counts = counts.withColumn("_upto", upto)
        open_ = state.filter(wide).alias("a").join(
            counts.alias("b"), _same(interval, "a", "b") & (F.col("a._rank") < F.col("b._upto")) & (F.col("a._rank") >= F.col("b._upto") - F.col("b._c")))
        narrowed = open_.select(*[F.col(f"a.{c}") for c in keys], F.col("b._least").alias("_lo"), F.col("b._most").alias("_hi"),
                                F.col("b._c").alias("_held"), F.col("a._rank"), (F.col("b._upto") - F.col("b._c")).alias("_before"))
        state = staged(narrowed.unionByName(state.filter(~wide)), "ranks")
    one = state.filter("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_value"))
    few = state.filter("_lo < _hi")
    spans = few.select(*interval).distinct()
    nth = F.row_number().over(Window.partitionBy(*interval).orderBy("_v")) - 1 + F.col("_before")
    rows = (v.alias("v").join(spans.alias("s"), _same(keys, "v", "s") & F.col("v._v").between(F.col("s._lo"), F.col("s._hi")))
            .select(*[F.col(f"s.{c}").alias(c) for c in interval], "v._v").withColumn("_nth", nth))
    found = few.alias("a").join(rows.alias("b"), _same(interval, "a", "b") & (F.col("a._rank") == F.col("b._nth"))).select(
        *[F.col(f"a.{c}") for c in keys], F.col("a._rank"), F.col("b._v").alias("_value"))
    values = staged(one.unionByName(found), "order-statistics")
    low, high = values.alias("low"), values.alias("high")
    out = (spots.alias("t").join(low, _same(keys, "t", "low") & (F.col("t._r0") == F.col("low._rank")))
           .join(high, _same(keys, "t", "high") & (F.col("t._r1") == F.col("high._rank"))))
    between = F.col("low._value") + (F.col("t._at") - F.col("t._r0")) * (F.col("high._value") - F.col("low._value"))
    return out.select(*[F.col(f"t.{k}").alias(c) for c, k in zip(group, keys)], "t.p", between.alias("value"))
