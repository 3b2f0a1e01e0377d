"""Ordering, neighbours, limits, sampling and set operations.

Spark has no implicit row order, so every "first N" or "next row" here takes
an explicit total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def neighbor_within(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str],
                    prefix: str = "next_", previous: bool = False,
                    bucket_width: int = 4096) -> DataFrame:
    """Exact ``lead(values)`` (or ``lag`` with ``previous``) over
    ``partition by keys order by order`` without putting a whole key group
    into one task.

    ``order`` must be an integral column, unique within ``keys``.  Rows are
    windowed inside ranges ``(keys, order div bucket_width)``, so a hot key is
    split over many tasks; the boundary row of a range takes the first (or
    last) row of the neighbouring non-empty range from a per-range summary of
    one row per range.  Only the boundary rows meet that summary, so that the
    others are shuffled once.
    """
    vals = F.struct(*[F.col(v) for v in values])
    d = df.withColumn("_rng", F.floor(F.col(order) / F.lit(bucket_width)))
    o = F.col(order).desc() if previous else F.col(order).asc()
    # Both readings of the window must see rows of equal order in one sequence.
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    d = d.withColumn("_nb", F.lead(vals).over(Window.partitionBy(*keys, "_rng").orderBy(o, tie)))
    pick = F.max_by if previous else F.min_by
    edges = d.groupBy(*keys, "_rng").agg(pick(vals, F.col(order)).alias("_edge"))
    ro = F.col("_rng").desc() if previous else F.col("_rng").asc()
    fill = edges.select(*keys, "_rng",
                        F.lead("_edge").over(Window.partitionBy(*keys).orderBy(ro)).alias("_fill"))
    on = F.col("d._rng").eqNullSafe(F.col("e._rng"))
    for k in keys:  # a null key is a group like any other
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"e.{k}"))
    last = d.filter(F.col("_nb").isNull()).drop("_nb").alias("d").join(fill.alias("e"), on, "left") \
        .select("d.*", F.col("_fill").alias("_nb"))
    out = d.filter(F.col("_nb").isNotNull()).unionByName(last)
    return out.select(*[F.col(c) for c in df.columns],
                      *[F.col("_nb")[v].alias(prefix + v) for v in values])


def rank_per_query(df: DataFrame, query_cols: Sequence[str], score: str, tie: str,
                   out: str = "rank", limit: int | None = None) -> DataFrame:
    """Row number within ``query_cols`` by (score desc, tie asc).

    With ``limit`` only ranks ``<= limit`` are kept (a ``WindowGroupLimit``
    trims each partition before the shuffle).  Without it a query may hold any
    share of the rows, so none is gathered: rows are dealt to ranges of
    (query, score, tie), written, numbered within their query's part of a
    range, and the query's rows in earlier ranges are added, from one count a
    query and range."""
    w = [F.col(score).desc(), F.col(tie).asc()]
    keys = list(query_cols)
    if limit is not None:
        r = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*w)))
        return r.filter(F.col(out) <= limit)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(c) for c in keys])
    ranged = staged(df.repartitionByRange(parts, *[F.col(c) for c in keys], *w)
                    .withColumns({"_range": F.spark_partition_id(), "_key": key}), "ranges")
    counts = ranged.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), (F.sum("_n").over(
        Window.partitionBy("_key").orderBy("_range")) - F.col("_n")).alias("_before"))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_key", "_range").orderBy(*w)))
    on = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r"))
    return local.join(before, on).select(*df.columns, (F.col("_before") + F.col("_at")).cast("int").alias(out))


def flag_first(df: DataFrame, n: int, order: Sequence[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``: whether a row is among the first ``n`` by ascending
    ``order`` (nulls first, ties by place in the written input).  The input is
    evaluated once; the n-th row's key is found by a top-n and one scan flags
    the rows by it, so that neither side is subtracted from the other."""
    key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    rows = staged(df.withColumns({"_row": F.monotonically_increasing_id(), "_order": key}), "ordered")
    first = rows.select("_order", "_row").orderBy("_order", "_row").limit(n)
    last = first.orderBy(F.desc("_order"), F.desc("_row")).limit(1).collect()  # one key
    if not last:
        return rows.select(*df.columns, F.lit(False).alias(out))
    at = F.struct(*[
        F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(rows.schema["_order"].dataType.fields, last[0]["_order"])])
    inside = (F.col("_order") < at) | ((F.col("_order") == at) & (F.col("_row") <= last[0]["_row"]))
    return rows.select(*df.columns, inside.alias(out))


def sort_by_score(df: DataFrame, score: str = "rag_score",
                  tie_cols: Sequence[str] = ("query_text", "hard_negative")) -> DataFrame:
    """Descending by score with a total tie order (a range-partitioned sort)."""
    return df.orderBy(F.col(score).desc(), *[F.col(c).asc() for c in tie_cols])


def top_and_bottom(df: DataFrame, n: int = 5, score: str = "rag_score",
                   tie_cols: Sequence[str] = ("query_text", "hard_negative")) -> DataFrame:
    """The first ``n`` and last ``n`` rows of :func:`sort_by_score`, tagged
    ``end`` = top/bottom with their position.  Each side is a
    ``TakeOrderedAndProject`` (per-partition top-n, then merge)."""
    top = df.orderBy(F.col(score).desc(), *[F.col(c).asc() for c in tie_cols]).limit(n) \
        .withColumn("end", F.lit("top"))
    bottom = df.orderBy(F.col(score).asc(), *[F.col(c).desc() for c in tie_cols]).limit(n) \
        .withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def head_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows by an explicit order (file order does not exist)."""
    return df.orderBy(*order).limit(n)


def sample_per_group(df: DataFrame, group: str, n: int, key: Column, seed: int = 42,
                     out: str | None = None) -> DataFrame:
    """``min(size, n)`` rows per group, repeatable: rows ordered by
    ``md5(seed || key)`` (ties by key) and the first ``n`` kept."""
    order = F.md5(F.concat(F.lit(str(seed)), key.cast("string")))
    w = Window.partitionBy(group).orderBy(order, key.cast("string"))
    col = out or "_sample_pos"
    r = df.withColumn(col, F.row_number().over(w)).filter(F.col(col) <= n)
    return r if out else r.drop(col)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    it = iter(frames)
    acc = next(it)
    for f in it:
        acc = acc.unionByName(f, allowMissingColumns=allow_missing)
    return acc


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def language_overlap(a: DataFrame, b: DataFrame, col: str = "lang") -> DataFrame:
    """Values present in both sets (must be empty for a zero-shot split)."""
    return a.select(col).intersect(b.select(col))


def require_disjoint(a: DataFrame, b: DataFrame, col: str = "lang") -> None:
    """Raise if a value of ``col`` is in both sets (reads one value)."""
    if shared := language_overlap(a, b, col).limit(1).collect():
        raise ValueError(f"{col} {shared[0][0]!r} is in both sets")
