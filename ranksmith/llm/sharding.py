"""Sharding by k-d tree partitioning.

The table's metadata span a box.  A node is split across its widest dimension
(relative to the whole table's width) at the weighted median of its bytes, and
so on until every leaf holds the target bytes.  Medians are found by
histograms: bytes are summed by node and bucket, the boundary bucket is
refined by a hash that orders equal values, and only sums are compared.

What a split moves are units: the rows of one text, which thus stay together.
A text whose copies hold more than ``1 / PIECES`` of a shard is cut into
pieces of about that size, so a hot text spreads evenly.

Defined results: a null text has size 1 like an empty one and is equal to it;
null metadata stand before all values; ties are ordered by the hash; repeated
rows each get their own slot; an empty table gives an empty result; with fewer
units than shards some shards stay empty.  Other columns are only digested
where rows are written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_digest, staged, text_or_empty

PIECES = 50
#: Bits of the position within the node's range, and of the hash below it.
RANGE_BITS, HASH_BITS = 16, 16
#: Rows that one task numbers at once.
SLOT_ROWS = 100_000


def metadata_value(df: DataFrame, name: str) -> Column:
    """The column as a number in its own order: of strings the first six bytes."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.NumericType) or isinstance(kind, T.BooleanType):
        return F.coalesce(c.cast("double"), F.lit(float("-inf")))
    text = F.rpad(F.hex(F.substring(c.cast("string").cast("binary"), 1, 6)), 12, "0")
    return F.when(c.isNull(), F.lit(-1.0)).otherwise(F.conv(text, 16, 10).cast("double"))


def _units(rows: DataFrame, dims: int, per_shard: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their unit's piece, and the units with weight and metadata."""
    # At most PIECES texts a shard are that heavy.
    heavy = (rows.groupBy("t1", "t2").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > per_shard / PIECES)
             .select("t1", "t2", F.ceil(F.col("bytes") / (per_shard / PIECES)).alias("pieces")))
    heavy = staged(heavy, "heavy")
    cut = rows.join(heavy, ["t1", "t2"], "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    cut = staged(cut, "rows")
    units = cut.groupBy("t1", "t2", "piece").agg(F.sum("size").alias("w"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(dims)])
    return cut, units


def _tree(units: DataFrame, dims: int, shards: int) -> DataFrame:
    """(t1, t2, piece, shard)."""
    axes = [f"d{i}" for i in range(dims)]
    lo_hi = [f(a).alias(f"{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    widths = lambda a: F.col(f"hi{a}") - F.col(f"lo{a}")
    units = staged(units.select("*", F.lit(0).alias("first"), F.lit(shards).alias("n")), "units")
    whole = units.agg(*lo_hi).first()  # one row
    span = {a: (whole[f"hi{a}"] or 0) - (whole[f"lo{a}"] or 0) if whole[f"lo{a}"] is not None else 0 for a in axes}
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        # A row a node, as in every table below but the histograms.
        relative = [F.struct((widths(a) / F.lit(float(span[a] or 1))).alias("wide"), F.lit(-i).alias("i")) for i, a in enumerate(axes)]
        nodes = (units.where("n > 1").groupBy("first", "n").agg(F.sum("w").alias("whole"), *lo_hi)
                 .withColumn("axis", -(F.greatest(*relative) if dims > 1 else relative[0])["i"])
                 .withColumn("lo", F.element_at(F.array(*[F.col(f"lo{a}") for a in axes]), F.col("axis") + 1))
                 .withColumn("hi", F.element_at(F.array(*[F.col(f"hi{a}") for a in axes]), F.col("axis") + 1))
                 .withColumn("budget", F.col("whole") * F.floor(F.col("n") / 2) / F.col("n"))
                 .select("first", "n", "axis", "lo", "hi", "budget"))
        nodes = staged(nodes, "nodes")
        value = F.element_at(F.array(*axes), F.col("axis") + 1)
        ranged = F.when(F.col("hi") > F.col("lo"), F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * ((1 << RANGE_BITS) - 1))).otherwise(0)
        below = F.pmod(F.xxhash64("t1", "t2", "piece", "first"), F.lit(1 << HASH_BITS))
        placed = units.join(nodes, ["first", "n"]).withColumn("b", ranged.cast("long")).withColumn("c", below)
        at = staged(_boundary(placed, "b", ["first", "n"]), "buckets").select("first", "n", F.col("bucket").alias("cut"), F.col("rest").alias("budget"))
        inner = placed.drop("budget").join(at, ["first", "n"]).where(F.col("b") == F.col("cut"))
        fine = _boundary(inner, "c", ["first", "n"])
        # The boundary bucket of the hash goes to the nearer side.
        nearer = F.col("rest") * 2 >= F.col("held")
        fine = fine.select("first", "n", F.when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("fine"))
        cuts = staged(at.select("first", "n", "cut").join(fine, ["first", "n"]).join(nodes.drop("budget"), ["first", "n"]), "cuts")
        marked = units.join(cuts, ["first", "n"], "left")
        left = (ranged < F.col("cut")) | ((ranged == F.col("cut")) & (below <= F.col("fine")))
        half = F.floor(F.col("n") / 2).cast("int")
        units = staged(marked.select(
            "t1", "t2", "piece", "w", *axes,
            F.when((F.col("n") > 1) & ~left, F.col("first") + half).otherwise(F.col("first")).alias("first2"),
            F.when(F.col("n") == 1, F.lit(1)).when(left, half).otherwise(F.col("n") - half).alias("n2"))
            .withColumnsRenamed({"first2": "first", "n2": "n"}), "units")
    return units.select("t1", "t2", "piece", F.col("first").alias("shard"))


def _boundary(rows: DataFrame, bucket: str, node: list[str]) -> DataFrame:
    """For each node the bucket in which its budget runs out, what is left of
    the budget there, and the bytes the bucket holds."""
    sums = rows.groupBy(*node, "budget", F.col(bucket).alias("bucket")).agg(F.sum("w").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*node).orderBy("bucket")) - F.col("held")
    found = sums.withColumn("rest", F.col("budget") - before).where(F.col("rest") >= 0)
    return (found.groupBy(*node).agg(F.max(F.struct("bucket", "rest", "held")).alias("m"))
            .select(*node, "m.bucket", "m.rest", "m.held"))


def assign(df: DataFrame, doc_id: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source"),
           shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, rd1, rd2 (row digest), size (UTF-8
    bytes plus 1), text_crc32, shard, slot (gapless from 0 in each shard).

    Give the number of ``shards`` or the ``target_bytes`` of one; ``dims`` are
    metadata columns, to which the text's size and a hash of it are added."""
    body = text_or_empty(text)
    size = (F.octet_length(body) + 1).cast("long")
    values = [*(metadata_value(df, d) for d in dims), F.log2(size), F.xxhash64(body).cast("double")]
    # Infinite widths would hide all others.
    values = [F.when(v == F.lit(float("-inf")), F.lit(-1.0)).otherwise(v) for v in values]
    rows = staged(df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), *row_digest(df), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), body).alias("t1"), F.xxhash64(F.lit(2), body).alias("t2"),
        *[v.alias(f"d{i}") for i, v in enumerate(values)], F.monotonically_increasing_id().alias("rid")), "sizes")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    cut, units = _units(rows, len(values), max(1.0, total / shards))
    placed = cut.join(_tree(units, len(values), shards), ["t1", "t2", "piece"])
    buckets = max(1, math.ceil(n / shards / SLOT_ROWS))
    placed = staged(placed.select("doc_id", "rd1", "rd2", "size", "text_crc32", "shard", "rid",
                                  F.pmod(F.xxhash64("rid"), F.lit(buckets)).alias("part")), "placed")
    sums = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("held"))
    start = sums.withColumn("start", F.sum("held").over(Window.partitionBy("shard").orderBy("part")) - F.col("held")).drop("held")
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid")) - 1
    return (placed.withColumn("nth", nth).join(start, ["shard", "part"])
            .select("doc_id", "rd1", "rd2", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot")))


def write_shards(df: DataFrame, path: str, **how) -> None:
    """Write the rows of ``df`` as Parquet, a folder for each shard.  Rows
    identical in every column share the first one's shard."""
    where = (assign(df, **how).groupBy(F.col("rd1").alias("_rs_rd1"), F.col("rd2").alias("_rs_rd2"))
             .agg(F.min("shard").alias("_rs_shard")))
    keyed = df.select("*", *row_digest(df, ("_rs_rd1", "_rs_rd2"))).join(where, ["_rs_rd1", "_rs_rd2"])
    keyed.drop("_rs_rd1", "_rs_rd2").withColumnRenamed("_rs_shard", "shard_id").write.partitionBy("shard_id").parquet(path)
