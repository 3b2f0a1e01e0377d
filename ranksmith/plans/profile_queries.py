"""Queries for the profiling aggregates of SURVEY §2.9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.select import quantile_threshold
from ..sources import testdata as td
from .registry import query, r6
from .relations_sql import with_rel


def _round_doubles(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_COLS = ("query_text", "gold_passage", "hard_negative")


def _len_profile_sql():
    parts = []
    for c in _COLS:
        n = f"length({c})"
        parts.append(f"""SELECT '{c}' AS "column", round(avg({n}), 6) AS mean,
            round(quantile_cont({n}, 0.5), 6) AS median, round(stddev_samp({n}), 6) AS std,
            CAST(min({n}) AS BIGINT) AS min, CAST(max({n}) AS BIGINT) AS max,
            round(quantile_cont({n}, 0.25), 6) AS q25, round(quantile_cont({n}, 0.75), 6) AS q75 FROM DIRTY""")
    return "\nUNION ALL\n".join(parts)


@query("length_profile", with_rel(_len_profile_sql(), "DIRTY"))
def q_length_profile(spark, sf_dir):
    return _round_doubles(P.length_profile(td.dirty(spark, sf_dir)))


@query("null_profile", with_rel("""
SELECT "column", CAST(nulls AS BIGINT) AS nulls, round(nulls * 100.0 / rows, 6) AS null_pct FROM (
  SELECT count(*) AS rows,
         unnest(['lang', 'query_text', 'gold_passage', 'hard_negative', '*']) AS "column",
         unnest([count(*) - count(lang), count(*) - count(query_text), count(*) - count(gold_passage),
                 count(*) - count(hard_negative),
                 4 * count(*) - count(lang) - count(query_text) - count(gold_passage) - count(hard_negative)]) AS nulls
  FROM DIRTY)""", "DIRTY"))
def q_null_profile(spark, sf_dir):
    return _round_doubles(P.null_profile(td.dirty(spark, sf_dir)))


@query("duplicate_profile", with_rel("""
SELECT CAST(sum(m) AS BIGINT) AS rows, CAST(sum(m - 1) AS BIGINT) AS duplicates,
       round(sum(m - 1) * 100.0 / sum(m), 6) AS dup_pct
FROM (SELECT count(*) AS m FROM DIRTY GROUP BY lang, query_text, gold_passage, hard_negative)""", "DIRTY"))
def q_duplicate_profile(spark, sf_dir):
    return _round_doubles(P.duplicate_profile(td.dirty(spark, sf_dir)))


@query("identical_pair_count", with_rel("""
SELECT count(*) AS rows, count(*) FILTER (WHERE gold_passage = hard_negative) AS identical,
       round(count(*) FILTER (WHERE gold_passage = hard_negative) * 100.0 / count(*), 6) AS identical_pct
FROM DIRTY""", "DIRTY"))
def q_identical_pair_count(spark, sf_dir):
    return _round_doubles(P.identical_pair_count(td.dirty(spark, sf_dir)))


@query("short_long_counts", with_rel("""
SELECT count(*) AS rows, count(*) FILTER (WHERE length(query_text) < 10) AS short_queries,
       count(*) FILTER (WHERE length(gold_passage) > 2000) AS long_gold,
       count(*) FILTER (WHERE length(hard_negative) > 2000) AS long_negative
FROM DIRTY""", "DIRTY"))
def q_short_long_counts(spark, sf_dir):
    return P.short_long_counts(td.dirty(spark, sf_dir))


@query("length_ratio_profile", with_rel("""
SELECT lang, round(avg(qg), 6) AS qg_mean, round(quantile_cont(qg, 0.5), 6) AS qg_median,
       round(avg(qn), 6) AS qn_mean, round(quantile_cont(qn, 0.5), 6) AS qn_median,
       round(avg(gn), 6) AS gn_mean, round(quantile_cont(gn, 0.5), 6) AS gn_median
FROM (SELECT lang, CAST(length(query_text) AS DOUBLE) / nullif(length(gold_passage), 0) AS qg,
             CAST(length(query_text) AS DOUBLE) / nullif(length(hard_negative), 0) AS qn,
             CAST(length(gold_passage) AS DOUBLE) / nullif(length(hard_negative), 0) AS gn FROM DIRTY)
GROUP BY lang""", "DIRTY"))
def q_length_ratio_profile(spark, sf_dir):
    return _round_doubles(P.length_ratio_profile(td.dirty(spark, sf_dir)))


@query("length_histogram", with_rel("""
WITH l AS (SELECT c AS "column", len FROM (
    SELECT unnest(['query_text', 'gold_passage', 'hard_negative']) AS c,
           unnest([length(query_text), length(gold_passage), length(hard_negative)]) AS len FROM DIRTY)
  WHERE len IS NOT NULL),
r AS (SELECT "column", min(len) AS mn, max(len) AS mx, count(*) AS n FROM l GROUP BY 1),
b AS (SELECT l."column", mn, mx, n,
             CAST(CASE WHEN mx = mn THEN 1
                       ELSE least(floor((len - mn) * 30.0 / (mx - mn)), 29) + 1 END AS INTEGER) AS bin
      FROM l JOIN r USING ("column"))
SELECT "column", bin, round(mn + (bin - 1) * (CAST(mx - mn AS DOUBLE) / 30.0), 6) AS lo,
       round(mn + bin * (CAST(mx - mn AS DOUBLE) / 30.0), 6) AS hi, count(*) AS count,
       round(count(*) / (n * (CAST(mx - mn AS DOUBLE) / 30.0)), 6) AS density
FROM b GROUP BY "column", bin, mn, mx, n""", "DIRTY"))
def q_length_histogram(spark, sf_dir):
    return _round_doubles(P.length_histogram(td.dirty(spark, sf_dir)))


@query("score_distribution", with_rel("""
SELECT count(rag_score) AS count, round(avg(rag_score), 6) AS mean, round(stddev_samp(rag_score), 6) AS std,
       round(min(rag_score), 6) AS min, round(max(rag_score), 6) AS max,
       round(quantile_cont(rag_score, 0.5), 6) AS median FROM SCORED""", "SCORED"))
def q_score_distribution(spark, sf_dir):
    return _round_doubles(P.score_distribution(td.scored(spark, sf_dir)))


@query("score_bands", with_rel("""
SELECT band, count, round(count * 100.0 / n, 6) AS pct FROM (
  SELECT count(*) AS n, unnest(['hard_gt_0.6', 'medium_0.4_0.6', 'easy_lt_0.4']) AS band,
         unnest([count(*) FILTER (WHERE rag_score > 0.6),
                 count(*) FILTER (WHERE rag_score >= 0.4 AND rag_score <= 0.6),
                 count(*) FILTER (WHERE rag_score < 0.4)]) AS count FROM SCORED)""", "SCORED"))
def q_score_bands(spark, sf_dir):
    return _round_doubles(P.score_bands(td.scored(spark, sf_dir)))


@query("eval_validation", with_rel("""
SELECT setting, lang, count(*) AS samples,
       CAST(sum((query IS NULL)::BIGINT + (passage IS NULL)::BIGINT + (setting IS NULL)::BIGINT
                + (lang IS NULL)::BIGINT) AS BIGINT) AS nulls,
       count(*) FILTER (WHERE length(query) = 0) AS empty_queries,
       count(*) FILTER (WHERE length(passage) = 0) AS empty_passages,
       (sum((query IS NULL)::BIGINT + (passage IS NULL)::BIGINT) = 0
        AND count(*) FILTER (WHERE length(query) = 0) = 0
        AND count(*) FILTER (WHERE length(passage) = 0) = 0) AS clean
FROM LANGEVAL GROUP BY setting, lang""", "LANGEVAL"))
def q_eval_validation(spark, sf_dir):
    return P.eval_validation(td.lang_eval(spark, sf_dir))


@query("dataset_summary", with_rel("""
SELECT setting, lang, count(*) AS samples, round(avg(length(query)), 6) AS avg_query_len,
       round(avg(length(passage)), 6) AS avg_passage_len,
       CAST(min(length(passage)) AS BIGINT) AS min_passage_len,
       CAST(max(length(passage)) AS BIGINT) AS max_passage_len
FROM LANGEVAL GROUP BY setting, lang""", "LANGEVAL"))
def q_dataset_summary(spark, sf_dir):
    return _round_doubles(P.dataset_summary(td.lang_eval(spark, sf_dir)))


@query("dataset_counts", with_rel("""
SELECT setting, lang, count(*) AS rows FROM LANGEVAL GROUP BY ROLLUP (setting, lang)""", "LANGEVAL"))
def q_dataset_counts(spark, sf_dir):
    return P.dataset_counts(td.lang_eval(spark, sf_dir))


@query("selection_metadata", with_rel("""
WITH t AS (SELECT quantile_cont(rag_score, 0.5) AS th FROM SCORED)
SELECT count(*) AS total_negatives, count(*) FILTER (WHERE rag_score >= th) AS selected_negatives,
       round(count(*) FILTER (WHERE rag_score >= th) * 100.0 / count(*), 6) AS selection_percentage,
       CAST(0.5 AS DOUBLE) AS quality_percentile, round(th, 6) AS score_threshold,
       round(avg(rag_score), 6) AS mean, round(stddev_samp(rag_score), 6) AS std,
       round(min(rag_score), 6) AS min, round(max(rag_score), 6) AS max,
       round(quantile_cont(rag_score, 0.5), 6) AS median,
       count(*) FILTER (WHERE rag_score > 0.6) AS hard_gt_0_6,
       count(*) FILTER (WHERE rag_score >= 0.4 AND rag_score <= 0.6) AS medium_0_4_0_6,
       count(*) FILTER (WHERE rag_score < 0.4) AS easy_lt_0_4
FROM SCORED, t GROUP BY th""", "SCORED"))
def q_selection_metadata(spark, sf_dir):
    s = td.scored(spark, sf_dir)
    return _round_doubles(P.selection_metadata(s, quantile_threshold(s, "rag_score", 0.5)))
