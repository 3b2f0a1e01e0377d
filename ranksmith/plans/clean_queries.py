"""Queries for the filters of SURVEY §2.3 over DIRTY / SCORED."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators.select import select_top_fraction
from ..sources import testdata as td
from .registry import query, r6
from .relations_sql import strip_sql, with_rel

_T = "lang, query_text, gold_passage, hard_negative"
_NOTNULL = "lang IS NOT NULL AND query_text IS NOT NULL AND gold_passage IS NOT NULL AND hard_negative IS NOT NULL"
_NONBLANK = f"{strip_sql('query_text')} <> '' AND {strip_sql('gold_passage')} <> ''"
_LEN = "length(query_text) BETWEEN 10 AND 512 AND length(gold_passage) BETWEEN 20 AND 2048"


def _out(df):
    return df.select("lang", F.md5("query_text").alias("query_md5"), F.md5("gold_passage").alias("gold_md5"),
                     F.md5("hard_negative").alias("neg_md5"))


_OUT = "SELECT lang, md5(query_text) AS query_md5, md5(gold_passage) AS gold_md5, md5(hard_negative) AS neg_md5 FROM "


@query("drop_nulls", with_rel(f"{_OUT} DIRTY WHERE {_NOTNULL}", "DIRTY"))
def q_drop_nulls(spark, sf_dir):
    return _out(clean.drop_nulls(td.dirty(spark, sf_dir)))


@query("drop_blank", with_rel(f"{_OUT} DIRTY WHERE {_NONBLANK}", "DIRTY"))
def q_drop_blank(spark, sf_dir):
    return _out(clean.drop_blank(td.dirty(spark, sf_dir)))


@query("length_bounds", with_rel(f"{_OUT} DIRTY WHERE {_LEN}", "DIRTY"))
def q_length_bounds(spark, sf_dir):
    return _out(clean.length_bounds(td.dirty(spark, sf_dir), clean.DEFAULT_BOUNDS))


@query("drop_identical_negative", with_rel(
    f"{_OUT} DIRTY WHERE hard_negative IS DISTINCT FROM gold_passage", "DIRTY"))
def q_drop_identical_negative(spark, sf_dir):
    return _out(clean.drop_identical_negative(td.dirty(spark, sf_dir)))


_CLEAN_SQL = f"""SELECT DISTINCT {_T} FROM DIRTY
WHERE {_NOTNULL} AND {_NONBLANK} AND {_LEN} AND hard_negative <> gold_passage"""


@query("clean_dataset", with_rel(f"{_OUT} ({_CLEAN_SQL})", "DIRTY"))
def q_clean_dataset(spark, sf_dir):
    return _out(clean.clean_dataset(td.dirty(spark, sf_dir)))


@query("distinct_rows", with_rel(f"{_OUT} (SELECT DISTINCT {_T} FROM DIRTY)", "DIRTY"))
def q_distinct_rows(spark, sf_dir):
    return _out(td.dirty(spark, sf_dir).distinct())


@query("retention_report", with_rel(f"""
WITH g AS (SELECT {_T}, count(*) AS m FROM DIRTY GROUP BY ALL),
f AS (SELECT m, ({_NOTNULL}) AS a,
             coalesce({_NONBLANK}, false) AS b, coalesce({_LEN}, false) AS c,
             hard_negative IS DISTINCT FROM gold_passage AS d FROM g),
one AS (SELECT sum(m) AS input, sum(CASE WHEN a THEN m END) AS not_null, count(*) FILTER (WHERE a) AS "distinct",
               count(*) FILTER (WHERE a AND b) AS non_blank, count(*) FILTER (WHERE a AND b AND c) AS length,
               count(*) FILTER (WHERE a AND b AND c AND d) AS not_identical FROM f)
SELECT CAST(step_no AS INTEGER) AS step_no, step, CAST(coalesce(rows, 0) AS BIGINT) AS rows,
       round(CAST(coalesce(rows, 0) AS DOUBLE) * 100.0 / input, 6) AS retained_pct
FROM (SELECT input, unnest([0, 1, 2, 3, 4, 5]) AS step_no,
             unnest(['input', 'not_null', 'distinct', 'non_blank', 'length', 'not_identical']) AS step,
             unnest([input, not_null, "distinct", non_blank, length, not_identical]) AS rows FROM one)""",
                                          "DIRTY"))
def q_retention_report(spark, sf_dir):
    return clean.retention_report(td.dirty(spark, sf_dir))


@query("preprocess_training", with_rel(f"""
SELECT lang, md5(q) AS query_md5, md5(g) AS gold_md5, md5(n) AS neg_md5 FROM (
  SELECT lang, {strip_sql('query_text')} AS q, {strip_sql('gold_passage')} AS g,
         {strip_sql('hard_negative')} AS n FROM DIRTY WHERE {_NOTNULL})
WHERE length(q) > 0 AND length(g) > 0 AND length(n) > 0 AND length(q) >= 5
  AND length(g) <= 2048 AND length(n) <= 2048 AND g <> n""", "DIRTY"))
def q_preprocess_training(spark, sf_dir):
    return _out(clean.preprocess_training(td.dirty(spark, sf_dir)))


@query("preprocess_training_stats", with_rel(f"""
SELECT count(*) AS rows, round(avg(length(q)), 6) AS avg_query_text_len,
       round(avg(length(g)), 6) AS avg_gold_passage_len, round(avg(length(n)), 6) AS avg_hard_negative_len
FROM (SELECT {strip_sql('query_text')} AS q, {strip_sql('gold_passage')} AS g,
             {strip_sql('hard_negative')} AS n FROM DIRTY WHERE {_NOTNULL})
WHERE length(q) >= 5 AND length(g) > 0 AND length(n) > 0
  AND length(g) <= 2048 AND length(n) <= 2048 AND g <> n""", "DIRTY"))
def q_preprocess_training_stats(spark, sf_dir):
    return clean.training_stats(clean.preprocess_training(td.dirty(spark, sf_dir)))


# Classified triplets: SCORED graded by its score, failures where the query
# length is a multiple of 7 (the model call failed -> not graded).
def _classified(spark, sf_dir):
    s = td.scored(spark, sf_dir)
    ok = F.length("query_text") % 7 != 0
    return s.withColumn("is_hard", F.when(ok, F.col("rag_score") > 0.5))


_CLASSIFIED_SQL = """SELECT *, CASE WHEN length(query_text) % 7 <> 0 THEN rag_score > 0.5 END AS is_hard FROM SCORED"""


@query("keep_hard", with_rel(f"""
SELECT md5(query_text) AS query_md5, md5(gold_passage) AS gold_md5, md5(hard_negative) AS neg_md5
FROM ({_CLASSIFIED_SQL}) WHERE is_hard""", "SCORED"))
def q_keep_hard(spark, sf_dir):
    h = clean.keep_hard(_classified(spark, sf_dir))
    return h.select(F.md5("query_text").alias("query_md5"), F.md5("gold_passage").alias("gold_md5"),
                    F.md5("hard_negative").alias("neg_md5"))


@query("threshold_select", with_rel("""
SELECT lang, md5(query_text) AS query_md5, md5(gold_passage) AS gold_md5, md5(hard_negative) AS neg_md5,
       round(rag_score, 6) AS rag_score
FROM SCORED WHERE rag_score >= (SELECT quantile_cont(rag_score, 0.5) FROM SCORED)""", "SCORED"))
def q_threshold_select(spark, sf_dir):
    sel, _ = select_top_fraction(td.scored(spark, sf_dir), p=0.5, sort=False)
    return sel.select("lang", F.md5("query_text").alias("query_md5"), F.md5("gold_passage").alias("gold_md5"),
                      F.md5("hard_negative").alias("neg_md5"), r6(F.col("rag_score")).alias("rag_score"))


@query("skip_missing_inputs", with_rel("""
SELECT lang, md5(gold_passage) AS gold_md5,
       CASE WHEN coalesce(query_text, '') = '' OR coalesce(hard_negative, '') = '' THEN 'unknown'
            ELSE 'graded' END AS status
FROM DIRTY""", "DIRTY"))
def q_skip_missing_inputs(spark, sf_dir):
    d = clean.skip_missing_inputs(td.dirty(spark, sf_dir), "query_text", "hard_negative")
    return d.select("lang", F.md5("gold_passage").alias("gold_md5"),
                    F.when(F.col("_missing_input"), "unknown").otherwise("graded").alias("status"))
