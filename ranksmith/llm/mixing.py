"""Mixing sources to target weights by hash thresholds.

Sizes are summed by source and hash bucket; where a source's budget runs out
is found bucket by bucket, each level of buckets nested in the boundary
bucket of the one before, and only that bucket is refined.  Documents are then
taken by comparing their hash with their source's threshold: nothing is
sorted but the bucket sums, and no text is moved.

Every document of a source is taken ``floor(target / source_size)`` times, and
those up to the threshold once more.  The threshold is the one whose sum comes
nearest to the rest of the target (the lower one if both are as near).

Defined results: a null text has size 0; null sources form one source, last in
order; a source without words has target 0 and nothing taken; rows with the
same id and text share a hash and are taken alike; an empty table gives an
empty result.  Other columns are not read; the operator's own names win over
theirs.  Reruns agree, since hashes depend on id and text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, text_or_empty

HASH_BITS = 60
#: Bits that each level of nested buckets takes; the boundary bucket of the
#: last level is resolved hash by hash.
LEVELS = (12, 12)


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def position_hash(doc_id: str, text: str) -> Column:
    """60 bits of MD5 over id and text."""
    key = F.concat(text_or_empty(doc_id), F.lit(":"), text_or_empty(text))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The shares of ``share`` of all sizes are given by weight; a target stops
    at ``most`` times its source's size and what is above goes to the others
    by weight, until none is above.  In order of size by weight the stopped
    sources come first, so one pass of running sums finds the level."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("nth", F.row_number().over(order))
              .withColumn("weight", weight).withColumn("stop", F.col("source_size") * most)
              .withColumn("ratio", F.col("stop") / F.col("weight")))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("stop").over(before), F.lit(0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    levels = ranked.withColumn("level", level)
    found = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "nth", "level"))).over(whole)["level"]
    target = F.least(F.coalesce(found, F.lit(float("inf"))) * F.col("weight"), F.col("stop").cast("double"))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold) for rows (source, size, hash) and budgets (source,
    budget): the hash up to which sizes are summed."""
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    inside, left = rows, HASH_BITS
    for bits in LEVELS:
        left -= bits
        inside = _boundary(inside, budgets, F.shiftright("hash", left), same)
        budgets = inside[1]
        inside = inside[0]
    by_hash = inside.groupBy("source", "hash").agg(F.sum("size").alias("size"))
    cum = F.sum("size").over(Window.partitionBy("source").orderBy("hash"))
    over = (by_hash.withColumn("cum", cum).alias("h").join(budgets.alias("b"), same("h", "b"))
            .where(F.col("cum") > F.col("budget"))
            .groupBy("h.source").agg(F.min(F.struct("hash", "cum", "size", "budget")).alias("at")))
    nearer = F.col("at.cum") - F.col("at.budget") < F.col("at.budget") - (F.col("at.cum") - F.col("at.size"))
    return over.select("source", F.when(nearer, F.col("at.hash")).otherwise(F.col("at.hash") - 1).alias("threshold"))


def _boundary(rows: DataFrame, budgets: DataFrame, bucket: Column, same) -> tuple[DataFrame, DataFrame]:
    """Rows of each source's bucket in which its budget runs out, and what is
    left of the budgets at the start of that bucket."""
    bucketed = rows.withColumn("bucket", bucket)
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    cum = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    at = (sums.withColumn("cum", cum).alias("s").join(budgets.alias("b"), same("s", "b"))
          .where(F.col("cum") > F.col("budget")).groupBy("s.source")
          .agg(F.min(F.struct(F.col("bucket"), (F.col("budget") - F.col("cum") + F.col("size")).alias("rest"))).alias("at"))
          .select("source", F.col("at.bucket").alias("bucket"), F.col("at.rest").alias("budget")))
    at = staged(at, "boundary")  # a row a source
    kept = (bucketed.alias("r").join(at.alias("a"), same("r", "a") & (F.col("r.bucket") == F.col("a.bucket")), "left_semi")
            .select("source", "size", "hash"))
    return kept, at.select("source", "budget")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """One row per row of ``df``: doc_id, size (words), source, hash,
    source_size, target (its source's) and copies (0 to ``most``).

    Sources in order of their code points, null last, take ``weights`` in
    turn and share ``share`` of all sizes."""
    rows = staged(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
                            word_count(text).alias("size"), position_hash(doc_id, text).alias("hash")), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The largest whole number of copies at or below the target, and the rest.
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = staged(source_targets(sizes, weights, share, most).withColumn("all", F.floor(per))
                  .withColumn("budget", F.col("target") - F.col("all") * F.col("source_size")), "targets")
    cut = staged(thresholds(rows.where(F.col("size") > 0), plan.select("source", "budget")), "cuts")
    plan = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(
        "p.*", "threshold")
    more = F.coalesce((F.col("hash") <= F.col("threshold")) & (F.col("budget") > 0), F.lit(False)).cast("long")
    return (rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")), "left")
            .select("doc_id", "size", "r.source", "hash", "source_size", F.round("target", 6).alias("target"),
                    (F.col("all") + more).cast("int").alias("copies")))


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Rows of ``df``, each as often as the mix takes it.  The decisions are
    joined by id and hash, a hash at a time; the texts move once."""
    picks = (mix(df, doc_id, text, source, **how).where(F.col("copies") > 0)
             .groupBy(F.col("hash").alias("_rs_hash"), F.col("source").alias("_rs_source"))
             .agg(F.max("copies").alias("_rs_copies")))
    keyed = df.select("*", position_hash(doc_id, text).alias("_rs_hash"))
    return (keyed.join(picks, (keyed["_rs_hash"] == picks["_rs_hash"])
                       & keyed[f"`{source}`"].cast("string").eqNullSafe(picks["_rs_source"]))
            .withColumn("_rs_nth", F.explode(F.sequence(F.lit(1), F.col("_rs_copies"))))
            .select(*[f"`{c}`" for c in df.columns]))
