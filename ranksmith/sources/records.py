"""Normalisation of nested source records into queries / corpus / qrels /
triplet tables (per-row array and struct expressions, no shuffles)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_concat
from .files import normalize_qrels, path_exists


def flatten_train_records(df: DataFrame, combine_title: bool = True) -> DataFrame:
    """Record ``(query_id, query, positive_passages[], negative_passages[])``
    -> ``query_id, query_text, title, gold_passage, hard_negative``: first
    positive (gold = ``title + " " + text`` when ``combine_title``), first
    negative as ``title + " " + text`` or ``""`` when there is none."""
    pos = F.try_element_at("positive_passages", F.lit(1))
    neg = F.try_element_at("negative_passages", F.lit(1))
    gold = title_concat(pos["title"], pos["text"]) if combine_title else pos["text"]
    return df.select(F.col("query_id").cast("string"), F.col("query").alias("query_text"),
                     pos["title"].alias("title"), gold.alias("gold_passage"),
                     F.coalesce(title_concat(neg["title"], neg["text"]), F.lit("")).alias("hard_negative"))


def qrels_from_records(df: DataFrame) -> DataFrame:
    """One qrels row per record from its first positive (score 1); records
    without positives give none."""
    pos = F.try_element_at("positive_passages", F.lit(1))
    return df.select(F.col("query_id").cast("string"), pos["docid"].cast("string").alias("corpus_id"),
                     F.lit(1).alias("score")).filter(F.col("corpus_id").isNotNull())


def explode_qrels(df: DataFrame, id_col: str = "id", ids: str = "article_ids") -> DataFrame:
    """A question with an array of relevant ids -> one qrels row per id."""
    return df.select(F.col(id_col).cast("string").alias("query_id"),
                     F.explode(F.col(ids).cast("array<string>")).alias("corpus_id"), F.lit(1).alias("score"))


def queries_from_records(df: DataFrame, text: str = "text",
                         id_cols: Sequence[str] = ("id", "doc_id", "query_id", "item_id")) -> DataFrame:
    """Records -> ``(_id, text)``: the first present id column, as string."""
    idc = next(c for c in id_cols if c in df.columns)
    return df.select(F.col(idc).cast("string").alias("_id"), F.col(text).alias("text"))


def replicate_qrels(qrels: DataFrame, langs: Sequence[str]) -> DataFrame:
    """The same (English) qrels attached to every translated language: a
    generator over the configured language list, not a join."""
    return qrels.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))


def replicate_qrels_file(spark: SparkSession, path: str, langs: Sequence[str]) -> DataFrame:
    """``replicate_qrels`` of a qrels file, and no rows where there is none."""
    qrels = normalize_qrels(spark, path) if path_exists(spark, path) else \
        spark.createDataFrame([], "query_id string, corpus_id string, score int")
    return replicate_qrels(qrels, langs)
