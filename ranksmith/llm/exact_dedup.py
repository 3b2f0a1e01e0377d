"""Exact deduplication by content-defined chunk recipes.

Texts without their white space are cut where their content says so (after a
character pair of a fixed kind, between ``MIN_CHUNK`` and ``MAX_CHUNK``
characters).  Chunks are deduplicated by digest, and the texts behind a digest
are compared: a digest with one text is a verified identifier; where two texts
share a digest, identifiers carry the text too.  A document's recipe is the
ordered list of its chunks' identifiers; texts are equal when recipes are.

Long texts move once, as chunks, for the comparison; after it only recipes do.

Defined results: null counts as empty; texts that are empty without white
space have the empty recipe and form one group; of equal texts the row with
the most code points in its original text stays, then the smallest id (null
last), then the smallest row digest, so rows identical in every column stand
for one row: each says kept, and ``deduplicated`` returns one of them.  An
empty table gives an empty result.  Other columns are only digested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, row_digest, staged, text_or_empty, without_white_space

MIN_CHUNK, MAX_CHUNK = 256, 4096
#: Characters after which a text may be cut: one of every four of the basic
#: Latin letters and digits, then one of every four of the next blocks.
CUT_BEFORE, CUT_AT = (
    "".join(chr(c) for c in range(0x30, 0x250) if chr(c).isalnum() and c % 4 == k) for k in (1, 2))
CHUNK = (rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?(?:(?<=[{CUT_BEFORE}][{CUT_AT}])|\z)"
         rf"|.{{1,{MAX_CHUNK}}}")


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """The text's chunks in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def md5(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def shared_digests(chunked: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that stand for more than one text, from a column ``chunk``.
    Copies of a chunk are merged before the shuffle."""
    return (chunked.groupBy(digest(F.col("chunk")).alias("digest"))
            .agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
            .where(F.col("lo") != F.col("hi")).select("digest"))


def recipes(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
            digest: Callable[[Column], Column] = md5) -> DataFrame:
    """One row per row of ``df``: doc_id, rd1 and rd2 (row digest), n_chars
    (code points of the original text), text_sha256 (of the normalised text),
    n_chunks and recipe."""
    norm = without_white_space(text_or_empty(text))
    base = df.select(F.col(f"`{doc_id}`").alias("doc_id"), *row_digest(df), F.monotonically_increasing_id().alias("rid"),
                     F.char_length(text_or_empty(text)).cast("long").alias("n_chars"), norm.alias("norm"))
    twice = staged(shared_digests(base.select(F.explode(chunks(F.col("norm"))).alias("chunk")), digest), "digests")
    listed = base.select("doc_id", "rd1", "rd2", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                         "rid", F.posexplode_outer(chunks(F.col("norm"))).alias("pos", "chunk"))
    listed = listed.withColumn("digest", digest(F.col("chunk")))
    identified = listed.join(twice.withColumnRenamed("digest", "_rs_twice"), F.col("digest") == F.col("_rs_twice"), "left")
    part = F.when(F.col("chunk").isNotNull(), F.struct("pos", F.when(F.col("_rs_twice").isNull(), F.col("digest")).otherwise(
        F.concat(F.col("digest"), F.col("chunk").cast("binary"))).alias("id")))
    return (identified.groupBy("rid", "doc_id", "rd1", "rd2", "n_chars", "text_sha256")
            .agg(F.sort_array(F.collect_list(part)).alias("parts"))
            .select("doc_id", "rd1", "rd2", "n_chars", "text_sha256", F.size("parts").alias("n_chunks"),
                    F.col("parts.id").alias("recipe")))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 digest: Callable[[Column], Column] = md5) -> DataFrame:
    """One row per row of ``df``: doc_id, rd1, rd2, keep_id, group_size, kept,
    text_sha256, n_chunks."""
    found = staged(recipes(df, doc_id, text, digest), "recipes")
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "rd1", "rd2")).alias("best")
    # Kept, so that the join reads it plainly and can split a hot recipe's rows.
    groups = staged(found.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    return found.join(groups, "recipe").select(
        "doc_id", "rd1", "rd2", F.col("best.doc_id").alias("keep_id"), "group_size",
        ((F.col("rd1") == F.col("best.rd1")) & (F.col("rd2") == F.col("best.rd2"))).alias("kept"),
        "text_sha256", "n_chunks")


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    return keep_rows(df, exact_groups(df, doc_id, text).where("kept").select("rd1", "rd2"))
