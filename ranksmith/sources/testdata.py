"""Test relations derived from the driver's tables (see FIXTURES.md §2).

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
size grows with the input tables.  ``plans/relations_sql.py`` defines the
same relations in DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import as_double_vector
from ..operators.ordering import neighbor_within

TABLES = ("documents", "benchmark", "conversations", "embeddings", "labels", "pages")

# Evaluation setting of each test-data language.
LANG_SETTING = [("de", "in_distribution"), ("fr", "in_distribution"),
                ("es", "out_of_distribution"), ("en", "zero_shot")]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def first_line(text: str):
    return F.substring_index(F.col(text), "\n", 1)


def pairs(spark, sf_dir) -> DataFrame:
    """PAIRS: user turn followed by an assistant turn -> (query, gold)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nxt = neighbor_within(conv, ["conv_id"], "turn", ["role", "text"])
    return nxt.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")) \
        .select("conv_id", "turn", F.col("text").alias("query_text"),
                F.col("next_text").alias("gold_passage"))


def passages(spark, sf_dir) -> DataFrame:
    """PASS: documents as a corpus with string ids."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("corpus_id"), "text", "lang", "source")


def bench_queries(spark, sf_dir) -> DataFrame:
    """BQ: benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), "text")


def bench_qrels(spark, sf_dir) -> DataFrame:
    """BQREL: (query, document) where the document contains the benchmark text."""
    from ..operators.relate import substring_containment_join
    q = bench_queries(spark, sf_dir).select("query_id", F.col("text").alias("needle"))
    d = passages(spark, sf_dir).select("corpus_id", "text")
    return substring_containment_join(q, "needle", d, "text") \
        .select("query_id", "corpus_id", F.lit(1).cast("int").alias("score"))


def dirty(spark, sf_dir) -> DataFrame:
    """DIRTY: triplets with nulls, blanks, identical pairs and duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    nb = neighbor_within(docs, ["lang"], "doc_id", ["text"])
    did = F.col("doc_id")
    b = nb.select(
        did, "lang",
        F.when(did % 23 == 0, F.lit("   "))
         .otherwise(first_line("text")).alias("query_text"),
        F.col("text").alias("gold_passage"),
        F.when(did % 17 == 0, F.lit(None).cast("string"))
         .when(did % 19 == 0, F.col("text"))
         .otherwise(F.col("next_text")).alias("hard_negative"))
    times = F.when(did % 29 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return b.withColumn("_times", F.explode(times)).select("lang", "query_text", "gold_passage", "hard_negative")


def lang_eval(spark, sf_dir) -> DataFrame:
    """LANGEVAL: (setting, lang, query, passage) evaluation pairs: a document's
    first line and its text.  Languages without a setting are ``unlisted``,
    documents without a language ``und``."""
    setting = F.lit("unlisted")
    for lang, name in LANG_SETTING:
        setting = F.when(F.col("lang") == lang, name).otherwise(setting)
    return table(spark, sf_dir, "documents").select(
        setting.alias("setting"), F.coalesce("lang", F.lit("und")).alias("lang"),
        first_line("text").alias("query"), F.col("text").alias("passage"))


def vectors(spark, sf_dir) -> DataFrame:
    """VEC: embeddings as double vectors."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", as_double_vector("embedding").alias("embedding"), "label")


def replies(spark, sf_dir) -> DataFrame:
    """RESP: one model reply per document, in one of fourteen forms by the
    length of its text; numbers come from the length, prose from the text."""
    n, head = F.coalesce(F.length("text"), F.lit(0)), F.coalesce(first_line("text"), F.lit(""))

    def number(m):
        return (n % m).cast("string")

    forms = [number(101), F.concat(F.lit("0."), F.lpad(number(100), 2, "0")), F.lit("1"), F.concat(number(120), F.lit("/100")),
             F.concat(number(12), F.lit(" out of 10")), F.concat(F.lit("Score: "), number(101)), F.concat(number(150), F.lit("%")),
             F.concat(number(5), F.lit("/4")), F.concat(F.lit("VERY HARD, "), head), F.concat(F.lit("MODERATELY HARD: "), head),
             F.concat(F.lit("VERY EASY because "), head), F.lit("nan"), head, F.lit("")]
    k = (n + F.coalesce(F.col("doc_id"), F.lit(0))) % len(forms)
    reply = forms[-1]
    for i, form in enumerate(forms[:-1]):
        reply = F.when(k == i, form).otherwise(reply)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), reply.alias("response"))


def scored(spark, sf_dir) -> DataFrame:
    """SCORED: DIRTY rows with a negative and a deterministic rag_score."""
    d = dirty(spark, sf_dir).filter(F.col("hard_negative").isNotNull())
    s = ((F.length("gold_passage") * 37 + F.length("query_text")) % 101) / F.lit(100.0)
    return d.withColumn("rag_score", s.cast("double"))


def nested(spark, sf_dir) -> DataFrame:
    """NESTED: one training record per conversation; assistant turns are the
    positives, system turns the negatives, the first user turn the query.

    A record's arrays are the content of one conversation, the way the
    source record format stores them.
    """
    conv = table(spark, sf_dir, "conversations")
    pos = F.struct(F.col("turn"), F.concat(F.col("conv_id").cast("string"), F.lit("-"),
                                           F.col("turn").cast("string")).alias("docid"),
                   F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"),
                   F.col("text").alias("text"))
    neg = F.struct(F.col("turn"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"),
                   F.col("text").alias("text"))
    g = conv.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("query"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", pos))).alias("pp"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "system", neg))).alias("np"))
    return g.select(
        F.col("conv_id").cast("string").alias("query_id"), "query",
        F.transform("pp", lambda s: F.struct(s["docid"].alias("docid"), s["title"].alias("title"),
                                             s["text"].alias("text"))).alias("positive_passages"),
        F.transform("np", lambda s: F.struct(s["title"].alias("title"),
                                             s["text"].alias("text"))).alias("negative_passages"))


def expectations(spark, sf_dir) -> DataFrame:
    """EXPECT: expected label from quality, predicted label from toxic = 0."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        "doc_id",
        F.when(F.col("quality") == 1, "HARD").otherwise("EASY").alias("expected"),
        F.when(F.col("toxic") == 0, "HARD").otherwise("EASY").alias("predicted"))


def verdict_replies(spark, sf_dir) -> DataFrame:
    """PAIRRESP: CLASSIFICATION/CONFIDENCE replies, one per document, in five
    shapes (hard, regular mentioning "not hard", no confidence, empty,
    unparsable confidence)."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    head = F.col("text")
    reply = (F.when(k == 0, F.concat(F.lit("CLASSIFICATION: HARD\nCONFIDENCE: 0.9\nREASON: "), head))
             .when(k == 1, F.concat(F.lit("Classification: regular\nConfidence: 0.35\nReason: not hard, "), head))
             .when(k == 2, F.concat(F.lit("CLASSIFICATION: REGULAR\nREASON: "), head))
             .when(k == 3, F.lit(""))
             .otherwise(F.lit("CLASSIFICATION: HARD\nCONFIDENCE: high")))
    return d.select(F.col("doc_id").alias("id"), reply.alias("response"))


def list_replies(spark, sf_dir) -> DataFrame:
    """NUMRESP: generation replies built from document text in four shapes
    (every line numbered, no numbers, preamble + multi-line items, empty)."""
    line = first_line("text")
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    reply = (F.when(k == 0, F.concat(F.lit("1. "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n2. "))))
             .when(k == 1, F.col("text"))
             .when(k == 2, F.concat(F.lit("Sure, here they are:\n1. "), line,
                                    F.lit("\n   more words\n\n2. "), F.col("text"),
                                    F.lit("\n3.\n4. "), line))
             .otherwise(F.lit("")))
    return d.select(F.col("doc_id").alias("id"), reply.alias("response"))


def bench_qrels_dirty(spark, sf_dir) -> DataFrame:
    """BQREL plus orphan rows: every pair again with a missing corpus id and
    with a missing query id."""
    ids = F.explode(F.array(*[F.struct(F.concat("query_id", F.lit(q)).alias("q"), F.concat("corpus_id", F.lit(c)).alias("c"))
                              for q, c in (("", ""), ("", "-missing"), ("-missing", ""))])).alias("ids")
    return bench_qrels(spark, sf_dir).select("score", ids).select(
        F.col("ids.q").alias("query_id"), F.col("ids.c").alias("corpus_id"), "score")
