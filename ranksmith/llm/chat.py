"""Chat formatting with cumulative-snapshot collapse.

Chats are often logged again after every turn, so that one conversation is
the beginning of the next.  Each turn gets a rolling hash of the turns up to
it; a conversation whose last hash is that of an inner turn of a longer one is
a snapshot of it.  Anti-joins leave the maximal conversations, which are then
rendered.

The rolling hash is the exclusive or of a 128-bit hash of every turn with its
position, so blocks of a long conversation are hashed apart and put together;
rendering yields one row for each block: ``BLOCK_TURNS`` turn numbers, or
fewer where they have over twice as many rows.

Defined results: null conversation ids are one conversation; a null role or
text is rendered as empty but told from an empty one by the hash; turns are
ordered by number (null first), then by hash, so repeated turns stay and ties
have one order; of equal conversations the one with the smallest id stays
(null last); an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK_TURNS = 1024
BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT = "<|im_start|>", "\n", "<|im_end|>\n"


def _md5(*parts: Column) -> Column:
    return F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).cast("binary"))


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, m, block).  A block of over twice
    ``BLOCK_TURNS`` rows is cut by ranges of turn numbers, by turn number, by
    hash, and equal turns are dealt out; at most one row for that many rows
    is broadcast.  Blocks in order hold the turns in order."""
    t = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                  F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    t = t.withColumn("m", _md5(F.col("role").alias("r"), F.col("text").alias("t")))
    zero, size = F.lit(0).cast("long"), F.lit(BLOCK_TURNS).cast("long")
    t = t.select("*", F.col("turn").isNotNull().alias("a"), F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), zero).alias("b"),
                 *[zero.alias(c) for c in ("range", "number", "bits")], F.lit("").alias("same"), zero.alias("nth"),
                 F.lit(True).alias("large"))
    parts = F.ceil(F.col("held") / BLOCK_TURNS)
    first = F.conv(F.substring("m", 1, 8), 16, 10).cast("long")  # 32 bits
    levels = {"range": F.coalesce(F.floor(F.pmod("turn", size) * F.least(parts, size) / BLOCK_TURNS), zero),
              "number": F.coalesce("turn", zero), "bits": F.shiftright(first * F.least(parts, F.lit(1 << 30).cast("long")), 32),
              "same": F.col("m"), "nth": F.pmod(F.monotonically_increasing_id(), parts)}
    block = ["a", "b", *levels]
    for name, finer in levels.items():
        keyed = t.withColumn("key", F.xxhash64("conv", *block))
        large = staged(keyed.where("large").groupBy("key").agg(F.count(F.lit(1)).alias("held"))
                       .where(F.col("held") > 2 * BLOCK_TURNS), "large-blocks")
        if large.isEmpty():
            break
        over = F.col("held").isNotNull()
        t = (keyed.join(F.broadcast(large), "key", "left")
             .withColumns({name: F.when(over, finer).otherwise(F.col(name)), "large": over}).drop("key", "held"))
    return t.select("conv", "turn", "role", "text", "m", F.struct(*block).alias("block"))


def prefixes(df: DataFrame, **names) -> DataFrame:
    """(conv, pos, n, p1, p2): for each turn the hash of the turns up to it;
    pos counts from 1, n is the conversation's number of turns."""
    t = staged(turns(df, **names).select("conv", "turn", "m", "block"), "blocks")  # equal turns are dealt once
    own, inner = Window.partitionBy("conv", "block"), Window.partitionBy("conv").orderBy("block")
    ranked = t.withColumn("rank", F.row_number().over(own.orderBy(F.col("turn").asc_nulls_first(), "m")))
    sizes = t.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("held"))
    sizes = sizes.select("conv", "block", (F.sum("held").over(inner) - F.col("held")).alias("start"),
                         F.sum("held").over(Window.partitionBy("conv")).alias("n"))
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))
    placed = ranked.alias("r").join(sizes.alias("s"), same("r", "s")).select(
        "r.conv", "r.block", "n", "m", (F.col("start") + F.col("rank")).alias("pos"))
    term = F.md5(F.concat_ws(":", "m", "pos").cast("binary"))
    hashed = placed.withColumn("term", term).select("conv", "block", "n", "pos", _half(F.col("term"), 1).alias("t1"), _half(F.col("term"), 17).alias("t2"))
    hashed = staged(hashed, "turns")
    sofar = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    sums = sums.select("conv", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    rolled = hashed.select("conv", "block", "n", "pos", F.bit_xor("t1").over(sofar).alias("t1"), F.bit_xor("t2").over(sofar).alias("t2"))
    return rolled.alias("r").join(sums.alias("s"), same("r", "s")).select(
        "r.conv", "pos", "n", F.col("t1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("t2").bitwiseXOR(F.col("b2")).alias("p2"))


def maximal(df: DataFrame, **names) -> DataFrame:
    """(conv, n, copies): conversations that begin no longer one, each distinct
    one once."""
    rolled = staged(prefixes(df, **names), "prefixes")
    first = F.min(F.struct(F.col("conv").isNull(), "conv")).alias("first")
    ends = (rolled.where(F.col("pos") == F.col("n")).groupBy("p1", "p2", "n")
            .agg(first, F.count(F.lit(1)).alias("copies")))
    inner = rolled.where(F.col("pos") < F.col("n")).select("p1", "p2", F.col("pos").alias("n")).distinct()
    return ends.join(inner, ["p1", "p2", "n"], "left_anti").select(F.col("first.conv").alias("conv"), "n", "copies")


def render(df: DataFrame, before_role: str = BEFORE_ROLE, after_role: str = AFTER_ROLE, after_text: str = AFTER_TEXT, **names) -> DataFrame:
    """(conv_id, part, n_turns, copies, chat) for the maximal conversations:
    ``chat`` renders the part's turns, parts count from 0 and join in order;
    n_turns and copies are the conversation's."""
    kept = staged(maximal(df, **names), "maximal")
    t = turns(df, **names)
    own = t.alias("t").join(kept.alias("k"), F.col("t.conv").eqNullSafe(F.col("k.conv"))).select("t.*", "n", "copies")
    line = F.concat(F.lit(before_role), F.coalesce("role", F.lit("")), F.lit(after_role), F.coalesce("text", F.lit("")), F.lit(after_text))
    parts = (own.groupBy("conv", "block", "n", "copies")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "m", line.alias("line")))).alias("lines")))
    nth = F.row_number().over(Window.partitionBy("conv").orderBy("block")) - 1
    return parts.select(F.col("conv").alias("conv_id"), nth.cast("long").alias("part"), F.col("n").alias("n_turns"), "copies",
                        F.array_join("lines.line", "").alias("chat"))
