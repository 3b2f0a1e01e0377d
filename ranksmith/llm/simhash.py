"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``r`` bits have a fingerprint between
them, within half the radius of both.  So every distinct fingerprint emits the
variants within half the radius, variants are brought together by a shuffle,
and what meets is verified and linked.  For an odd radius ``r = 2k + 1``:

* every fingerprint emits its ball of ``k`` flips: what meets there differs in
  at most ``2k`` bits;
* pairs at an odd distance up to ``r`` have popcounts of different parity, so
  the odd ones also emit ``k + 1`` flips and meet the even ones' ball of ``k``.
  Of ``2k + 1`` differing bits, ``k + 1`` lie in the same half of the
  fingerprint, so flips within one half are enough and lose no pair.

A variant is reached by a number of distinct fingerprints that the radius
bounds, whatever the data; each is linked to the smallest that reaches the
variant with ``k`` flips, which keeps components whole without listing the
pairs of a group.  Copies are merged into their fingerprint before all this.

Defined results: a null or empty text, or one of white space, has fingerprint
zero and is linked like any other; texts of fewer words than a shingle are one
shingle; a bit set in exactly half of the shingles is 0; rows with equal
fingerprints are one node, so repeated rows and ties are linked; null ids take
part, and a component of null ids only has a null id.  Empty tables give empty
results.  Other columns are only digested where whole rows are returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_rows, map_texts, row_digest, staged

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """The text's fingerprint as an unsigned 64-bit integer."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(words) - shingle_words + 1
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if n <= 1:
        return hashed(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle_words - 1:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, BLOCK):
        hs = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[lo:lo + BLOCK], stops[lo:lo + BLOCK])], "<u8")
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", shingle_words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the text) and ``fp``, the fingerprint
    as a signed long."""
    def make_kernel():
        def kernel(texts: list) -> list:
            return [np.array([fingerprint(t or b"", shingle_words) for t in texts], "<u8").view("<i8").tolist()]
        return kernel
    return map_texts(df, text, make_kernel, [T.StructField("fp", T.LongType())], keep)


def _masks(flips: int, lo: int = 0, hi: int = 64) -> list[int]:
    out = [sum(1 << b for b in bits) for bits in combinations(range(lo, hi), flips)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


#: Fingerprints for each partition of the variants: their heads, at most 65
#: rows a fingerprint, take some 30 MB there.
NODES_A_PART = 1 << 14


def _flipped(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(variant, nth), a row for each mask; ``_unflipped`` has the fingerprint
    from them, so that each row moves one random number and a small one."""
    return (nodes.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("nth", "mask"))
            .select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "nth"))


def _unflipped(masks: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("nth") + 1).bitwiseXOR(F.col("variant")).alias("fp")


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): distinct links between the distinct fingerprints ``nodes.fp``
    whose components are those of all pairs within ``radius`` bits."""
    k, odd = divmod(radius, 2)
    ball = [m for i in range(k + 1) for m in _masks(i)]
    # Few bytes become many rows: deal them out first.
    spark = nodes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The join holds a partition's heads in memory: their number follows the data.
    parts = max(tasks, nodes.count() // NODES_A_PART + 1)
    nodes = nodes.repartition(tasks, "fp")
    core = (_flipped(nodes, ball).repartition(parts, "variant").select("variant", _unflipped(ball))
            .withColumn("head", F.min("fp").over(Window.partitionBy("variant"))))
    found = core.where(F.col("fp") != F.col("head")).select("fp", "head")
    if odd:
        shell = _masks(k + 1, 0, 32) + _masks(k + 1, 32, 64)
        outer = _flipped(nodes.where(F.bit_count("fp") % 2 == 1), shell)
        # Only variants that an odd fingerprint can reach with k + 1 flips.
        heads = core.where((F.col("fp") == F.col("head")) & (F.bit_count("variant") % 2 == k % 2)).select("variant", "head")
        met = outer.repartition(parts, "variant").join(heads.hint("shuffle_hash"), "variant")
        found = found.unionByName(met.select(_unflipped(shell), "head"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= radius
    return found.where(near & (F.col("fp") != F.col("head"))).select(
        F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): label is the smallest
    node of the component.  Rounds of taking the smallest label of the
    neighbours and then that label's own label, until nothing changes."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        step = staged(step.join(jump, "to").select("node", F.least("to", "further").alias("label"), "was"), "labels")
        changed = step.where(F.col("label") != F.col("was")).limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def near_components(marked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, label): the component of each fingerprint in ``marked.fp`` that has
    a link; label is its smallest fingerprint."""
    nodes = staged(marked.select("fp").distinct(), "nodes")
    return components(links(nodes, radius)).select(F.col("node").alias("fp"), "label")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3,
                radius: int = 3) -> DataFrame:
    """One row per row of ``df``: doc_id, rd1, rd2, fp, label (the component's
    smallest fingerprint), component_id (its smallest doc_id)."""
    given = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_rs_text"), *row_digest(df))
    marked = staged(fingerprints(given, "_rs_text", shingle_words), "fingerprints")
    found = near_components(marked, radius)
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labelled = staged(firsts.join(found, "fp", "left")
                      .select("fp", "first", F.coalesce("label", "fp").alias("label")), "firsts")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    per_fp = labelled.select("fp", "label").join(smallest, "label")
    return marked.join(per_fp, "fp").select("doc_id", "rd1", "rd2", "fp", "label", "component_id")


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3,
                 radius: int = 3) -> DataFrame:
    """One row of ``df`` for each component, with all its columns: the one
    with the smallest doc_id (null last), then the smallest row digest."""
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rd1", "rd2")).alias("best")
    winners = near_groups(df, doc_id, text, shingle_words, radius).groupBy("label").agg(best)
    return keep_rows(df, winners.select("best.rd1", "best.rd2"))
