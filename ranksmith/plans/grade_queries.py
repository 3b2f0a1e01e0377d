"""Queries for model-graded negatives with the offline
stand-in models, mirrored in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import NUMBER
from ..operators import bm25, clean, dense, grade, relate
from ..sources import testdata as td
from .clean_queries import _CLEAN_SQL
from .registry import ORACLE, query, r6
from .relate_queries import _cleaned_dirty
from .relations_sql import dense_context_sql, strip_sql, tok_sql, with_rel
from .text_queries import hardness_sql, upper_strip_sql

_D100 = "CAST(100.0 AS DOUBLE)"


def _overlap_reply(neg: str, ctx_list: str, empty: str) -> str:
    """SQL of the offline scorers' reply: share of distinct ``neg`` tokens in
    ``ctx_list`` as a 0-100 integer string."""
    nt = f"list_distinct({neg})"
    k = f"len(list_filter({nt}, lambda x: list_contains({ctx_list}, x)))"
    return (f"CASE WHEN len({nt}) = 0 THEN '{empty}' ELSE "
            f"CAST(CAST(floor({_D100} * {k} / len({nt}) + 0.5) AS BIGINT) AS VARCHAR) END")


_GRADE_REPLY = _overlap_reply(tok_sql("substr(hard_negative, 1, 300)"),
                              f"list_concat({tok_sql('substr(query_text, 1, 200)')}, "
                              f"{tok_sql('substr(gold_passage, 1, 300)')})", "no idea")


def _graded_sql(src: str) -> str:
    """CTE body: rows of ``src`` + reply, success, score, labels."""
    return f"""SELECT *, CASE WHEN NOT success THEN 'UNKNOWN' WHEN score > 0.5 THEN 'HARD' ELSE 'EASY' END
                          AS llm_classification,
                 CASE WHEN success THEN score > 0.5 END AS is_hard,
                 CASE WHEN success THEN score ELSE 0.5 END AS hardness_score
FROM (SELECT *, {hardness_sql(False)} AS score FROM (
  SELECT *, {upper_strip_sql('reply')} AS s FROM (
    SELECT *, CASE WHEN success THEN {_GRADE_REPLY} END AS reply FROM (
      SELECT *, coalesce({strip_sql('query_text')} <> '', false) AS success FROM {src}))))"""


def _graded_out(df):
    return df.select("lang", F.md5("query_text").alias("query_md5"), F.md5("hard_negative").alias("neg_md5"),
                     "llm_classification", "is_hard", r6(F.col("hardness_score")).alias("hardness_score"))


@query("grade_negatives", with_rel(f"""
WITH g AS ({_graded_sql('SCORED')})
SELECT lang, md5(query_text) AS query_md5, md5(hard_negative) AS neg_md5, llm_classification, is_hard,
       round(hardness_score, 6) AS hardness_score FROM g""", "SCORED"))
def q_grade_negatives(spark, sf_dir):
    return _graded_out(grade.grade_negatives(td.scored(spark, sf_dir), grade.overlap_grader))


_ORDER = ["query_text", "gold_passage", "hard_negative", "lang"]


@query("grade_batch", with_rel(f"""
WITH g AS ({_graded_sql('SCORED')})
SELECT lang, md5(query_text) AS query_md5, md5(hard_negative) AS neg_md5, llm_classification,
       round(hardness_score, 6) AS hardness_score, success,
       CASE WHEN NOT success THEN 'ValueError: empty query' END AS error FROM g""", "SCORED"))
def q_grade_batch(spark, sf_dir):
    g, _ = grade.grade_batch(td.scored(spark, sf_dir), _ORDER, model=grade.overlap_grader)
    return g.select("lang", F.md5("query_text").alias("query_md5"), F.md5("hard_negative").alias("neg_md5"),
                    "llm_classification", r6(F.col("hardness_score")).alias("hardness_score"), "success", "error")


_SHARE = (f"CAST(len(list_filter(list_distinct({tok_sql('negative')}), lambda x: list_contains({tok_sql('query')}, x))) "
          f"AS DOUBLE) / len(list_distinct({tok_sql('negative')}))")
_PAIR_REPLY = (f"CASE WHEN len(list_distinct({tok_sql('negative')})) = 0 THEN '' ELSE "
               f"'CLASSIFICATION: ' || CASE WHEN {_SHARE} >= 0.3 THEN 'HARD' ELSE 'REGULAR' END || chr(10) || "
               f"'CONFIDENCE: ' || printf('%.2f', {_SHARE}) || chr(10) || 'REASON: token overlap' END")
_NUM = NUMBER


def _verdict_sql(src: str) -> str:
    f = strip_sql("split_part(regexp_extract(t, '([^' || chr(10) || ']*CONFIDENCE:[^' || chr(10) || ']*)', 1), ':', 2)")
    return f"""SELECT *,
  CASE WHEN reply = '' THEN false ELSE contains(t, 'HARD') AND contains(t, 'CLASSIFICATION:') END AS is_hard_negative,
  CASE WHEN reply = '' THEN 0.5 ELSE coalesce(CASE WHEN contains(t, 'CONFIDENCE:') AND regexp_matches({f}, '{_NUM}')
                                                   THEN CAST({f} AS DOUBLE) END, 0.7) END AS confidence,
  CASE WHEN reply = '' THEN 'Empty response' END AS error
FROM (SELECT *, upper(reply) AS t FROM (SELECT *, {_PAIR_REPLY} AS reply FROM {src}))"""


@query("grade_pairs", with_rel(f"""
WITH src AS (SELECT lang, query_text AS query, hard_negative AS negative FROM SCORED),
v AS ({_verdict_sql('src')})
SELECT lang, md5(query) AS query_md5, md5(negative) AS neg_md5, is_hard_negative, round(confidence, 6) AS confidence,
       error FROM v""", "SCORED"))
def q_grade_pairs(spark, sf_dir):
    s = td.scored(spark, sf_dir).select("lang", F.col("query_text").alias("query"),
                                        F.col("hard_negative").alias("negative"))
    g = grade.grade_pairs(s, "query", "negative", grade.pair_judge())
    return g.select("lang", F.md5("query").alias("query_md5"), F.md5("negative").alias("neg_md5"),
                    "is_hard_negative", r6(F.col("confidence")).alias("confidence"), "error")


@query("grade_pairs_partial", with_rel(f"""
WITH o AS (SELECT *, row_number() OVER (ORDER BY query_text, gold_passage, hard_negative, lang) AS rn FROM SCORED),
src AS (SELECT lang, query_text, gold_passage, hard_negative, query_text AS query, hard_negative AS negative
        FROM o WHERE rn <= 200),
v AS ({_verdict_sql('src')})
SELECT lang, md5(query_text) AS query_md5, md5(hard_negative) AS neg_md5,
       CASE WHEN error IS NOT NULL THEN 'unknown' WHEN is_hard_negative THEN 'hard' ELSE 'regular' END
         AS llm_classification,
       round(CASE WHEN error IS NOT NULL THEN 0.0 ELSE confidence END, 6) AS llm_confidence FROM v
UNION ALL
SELECT lang, md5(query_text), md5(hard_negative), 'unknown', 0.0 FROM o WHERE rn > 200""", "SCORED"))
def q_grade_pairs_partial(spark, sf_dir):
    s = td.scored(spark, sf_dir).select("lang", "query_text", "gold_passage", "hard_negative")
    g = grade.grade_pairs_partial(s, 200, _ORDER, grade.pair_judge())
    return g.select("lang", F.md5("query_text").alias("query_md5"), F.md5("hard_negative").alias("neg_md5"),
                    "llm_classification", r6(F.col("llm_confidence")).alias("llm_confidence"))


def _gen_sql() -> str:
    return with_rel(f"""
WITH cd AS ({_CLEAN_SQL}),
NUMRESP AS (SELECT md5(lang || chr(1) || query_text || chr(1) || gold_passage || chr(1) || hard_negative) AS id, query_text, gold_passage,
                   'Here are the passages:' || chr(10) || array_to_string(list_transform(
                       list_slice(string_split(gold_passage, chr(10)), 1, 3),
                       lambda x, i: CAST(i AS VARCHAR) || '. ' || x), chr(10)) AS response
            FROM cd),
parsed AS ({_numbered_from('NUMRESP')})
SELECT md5(n.query_text) AS query_md5, md5(n.gold_passage) AS gold_md5, p.item_no AS negative_num,
       md5(p.item) AS neg_md5
FROM NUMRESP n JOIN parsed p USING (id)""", "DIRTY")


def _numbered_from(src: str) -> str:
    return f"""
SELECT id, CAST(item_no AS INTEGER) AS item_no, item FROM (
  SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY item_grp) AS item_no FROM (
    SELECT id, item_grp, string_agg(content, ' ' ORDER BY ln) AS item FROM (
      SELECT id, ln,
             sum(CASE WHEN marker THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ln ROWS UNBOUNDED PRECEDING)
               AS item_grp,
             CASE WHEN marker THEN {strip_sql('substr(st, 3)')} ELSE st END AS content
      FROM (SELECT id, ln, st, st <> '' AND regexp_matches(st, '^[1-9][.]') AS marker
            FROM (SELECT id, ln, {strip_sql('line')} AS st
                  FROM (SELECT id, unnest(parts) AS line, generate_subscripts(parts, 1) AS ln
                        FROM (SELECT id, string_split(coalesce(response, ''), chr(10)) AS parts FROM {src})))))
    WHERE content <> '' GROUP BY id, item_grp))
WHERE item_no <= 3"""


def _generated(spark, sf_dir):
    return grade.generate_negatives(clean.clean_dataset(td.dirty(spark, sf_dir)), n=3)


@query("generate_negatives", _gen_sql())
def q_generate_negatives(spark, sf_dir):
    g = _generated(spark, sf_dir)
    return g.select(F.md5("query_text").alias("query_md5"), F.md5("gold_passage").alias("gold_md5"),
                    "negative_num", F.md5("hard_negative").alias("neg_md5"))


@query("assemble_final", with_rel(f"""
WITH g AS ({_graded_sql('SCORED')}),
cd AS ({_CLEAN_SQL}),
NUMRESP AS (SELECT md5(lang || chr(1) || query_text || chr(1) || gold_passage || chr(1) || hard_negative) AS id, query_text, gold_passage,
                   'Here are the passages:' || chr(10) || array_to_string(list_transform(
                       list_slice(string_split(gold_passage, chr(10)), 1, 3),
                       lambda x, i: CAST(i AS VARCHAR) || '. ' || x), chr(10)) AS response FROM cd),
parsed AS ({_numbered_from('NUMRESP')})
SELECT md5(query_text) AS query_md5, md5(gold_passage) AS gold_md5, md5(hard_negative) AS neg_md5 FROM g WHERE is_hard
UNION ALL
SELECT md5(n.query_text), md5(n.gold_passage), md5(p.item) FROM NUMRESP n JOIN parsed p USING (id)""", "SCORED"))
def q_assemble_final(spark, sf_dir):
    hard = clean.keep_hard(grade.grade_negatives(td.scored(spark, sf_dir), grade.overlap_grader))
    out = grade.assemble_final(hard, _generated(spark, sf_dir))
    return out.select(F.md5("query_text").alias("query_md5"), F.md5("gold_passage").alias("gold_md5"),
                      F.md5("hard_negative").alias("neg_md5"))


_CTX_REPLY = _overlap_reply(tok_sql("substr(hard_negative, 1, 200)"),
                            f"list_concat({tok_sql('query_text')}, flatten(list_transform(ctxs, lambda c: "
                            f"{tok_sql('substr(c, 1, 120)')})))", "50")


@query("score_with_context", with_rel(f"""
WITH cleaned AS ({_CLEAN_SQL}),{dense_context_sql(
    "SELECT query_text FROM cleaned",
    "SELECT gold_passage AS passage FROM cleaned UNION ALL SELECT hard_negative FROM cleaned")},
ctxl AS (SELECT query_text, list(passage ORDER BY rn) AS ctxs FROM CTX GROUP BY ALL),
j AS (SELECT c.*, coalesce(x.ctxs, []) AS ctxs FROM cleaned c LEFT JOIN ctxl x USING (query_text)),
r AS (SELECT *, {_CTX_REPLY} AS reply FROM j)
SELECT lang, md5(query_text) AS query_md5, md5(hard_negative) AS neg_md5,
       round(coalesce(CASE WHEN regexp_matches({strip_sql('reply')}, '{_NUM}') THEN least(greatest(
         (CASE WHEN CAST({strip_sql('reply')} AS DOUBLE) > 1 THEN CAST({strip_sql('reply')} AS DOUBLE) / 100.0
               ELSE CAST({strip_sql('reply')} AS DOUBLE) END), 0.0), 1.0) END, 0.5), 6) AS rag_score
FROM r""", "DIRTY"))
def q_score_with_context(spark, sf_dir):
    cleaned = _cleaned_dirty(spark, sf_dir)
    top = dense.nearest_texts(cleaned, bm25.build_corpus(cleaned), dense.hashed_bow_encoder(64), k=3)
    j = relate.attach_context(cleaned, top, "query_text", k=3)
    s = grade.score_with_context(j, grade.context_scorer)
    return s.select("lang", F.md5("query_text").alias("query_md5"), F.md5("hard_negative").alias("neg_md5"),
                    r6(F.col("rag_score")).alias("rag_score"))


@query("score_dedup_by_key", with_rel(f"""
WITH k AS (SELECT *, md5(query_text || '|' || gold_passage || '|'
                         || hard_negative) AS cache_key FROM SCORED),
reps AS (SELECT cache_key, count(*) AS key_rows, min({{'query_text': query_text, 'gold_passage': gold_passage,
                                                       'hard_negative': hard_negative}}) AS t FROM k GROUP BY cache_key),
r2 AS (SELECT cache_key, key_rows, t.query_text AS query_text, t.gold_passage AS gold_passage,
              t.hard_negative AS hard_negative FROM reps),
g AS ({_graded_sql('r2')})
SELECT k.lang, k.cache_key, g.key_rows, round(g.hardness_score, 6) AS rag_score
FROM k JOIN g USING (cache_key)""", "SCORED"))
def q_score_dedup_by_key(spark, sf_dir):
    def scorer(reps):
        return grade.grade_negatives(reps, grade.overlap_grader).withColumnRenamed("hardness_score", "rag_score")
    d = grade.score_dedup_by_key(td.scored(spark, sf_dir), scorer)
    return d.select("lang", "cache_key", "key_rows", r6(F.col("rag_score")).alias("rag_score"))


@query("grader_accuracy", with_rel("""
WITH per AS (SELECT expected, count(*) FILTER (WHERE expected = predicted) AS correct,
                    count(*) FILTER (WHERE expected <> predicted) AS incorrect FROM EXPECT GROUP BY expected
             UNION ALL
             SELECT 'ALL', count(*) FILTER (WHERE expected = predicted), count(*) FILTER (WHERE expected <> predicted)
             FROM EXPECT)
SELECT expected, correct, incorrect, round(correct * 100.0 / (correct + incorrect), 6) AS accuracy_pct,
       CASE WHEN correct * 100.0 / (correct + incorrect) >= 87.5 THEN 'EXCELLENT'
            WHEN correct * 100.0 / (correct + incorrect) >= 75 THEN 'GOOD'
            WHEN correct * 100.0 / (correct + incorrect) >= 62.5 THEN 'FAIR' ELSE 'POOR' END AS verdict
FROM per""", "EXPECT"))
def q_grader_accuracy(spark, sf_dir):
    a = grade.grader_accuracy(td.expectations(spark, sf_dir))
    return a.withColumn("accuracy_pct", r6(F.col("accuracy_pct")))


@query("class_counts", with_rel(f"""
WITH g AS ({_graded_sql('SCORED')})
SELECT llm_classification, count(*) AS count, round(avg(hardness_score), 6) AS mean_score,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM g GROUP BY llm_classification""", "SCORED"))
def q_class_counts(spark, sf_dir):
    from ..operators.profile import class_counts
    c = class_counts(grade.grade_negatives(td.scored(spark, sf_dir), grade.overlap_grader))
    return c.select("llm_classification", "count", r6(F.col("mean_score")).alias("mean_score"),
                    r6(F.col("pct")).alias("pct"))


# --- the same over whole texts -----------------------------------------------------------

_WHOLE_GRADE_REPLY = _overlap_reply(tok_sql("hard_negative"),
                                    f"list_concat({tok_sql('query_text')}, {tok_sql('gold_passage')})", "no idea")
_WHOLE_CTX_REPLY = _overlap_reply(tok_sql("hard_negative"),
                                  f"list_concat({tok_sql('query_text')}, flatten(list_transform(ctxs, lambda c: "
                                  f"{tok_sql('c')})))", "50")


def _whole_sql(name: str) -> str:
    return ORACLE[name].replace(_GRADE_REPLY, _WHOLE_GRADE_REPLY).replace(_CTX_REPLY, _WHOLE_CTX_REPLY)


def _graded_whole(df):
    return grade.grade_negatives(df, grade.overlap_grader, widths=None)


@query("grade_negatives_whole", _whole_sql("grade_negatives"))
def q_grade_negatives_whole(spark, sf_dir):
    return _graded_out(_graded_whole(td.scored(spark, sf_dir)))


@query("grade_batch_whole", _whole_sql("grade_batch"))
def q_grade_batch_whole(spark, sf_dir):
    g, _ = grade.grade_batch(td.scored(spark, sf_dir), _ORDER, model=grade.overlap_grader, widths=None)
    return g.select("lang", F.md5("query_text").alias("query_md5"), F.md5("hard_negative").alias("neg_md5"),
                    "llm_classification", r6(F.col("hardness_score")).alias("hardness_score"), "success", "error")


@query("score_with_context_whole", _whole_sql("score_with_context"))
def q_score_with_context_whole(spark, sf_dir):
    cleaned = _cleaned_dirty(spark, sf_dir)
    top = dense.nearest_texts(cleaned, bm25.build_corpus(cleaned), dense.hashed_bow_encoder(64), k=3)
    j = relate.attach_context(cleaned, top, "query_text", k=3)
    s = grade.score_with_context(j, grade.context_scorer, widths=None)
    return s.select("lang", F.md5("query_text").alias("query_md5"), F.md5("hard_negative").alias("neg_md5"),
                    r6(F.col("rag_score")).alias("rag_score"))


@query("score_dedup_by_key_whole", _whole_sql("score_dedup_by_key"))
def q_score_dedup_by_key_whole(spark, sf_dir):
    d = grade.score_dedup_by_key(td.scored(spark, sf_dir),
                                 lambda reps: _graded_whole(reps).withColumnRenamed("hardness_score", "rag_score"))
    return d.select("lang", "cache_key", "key_rows", r6(F.col("rag_score")).alias("rag_score"))


@query("class_counts_whole", _whole_sql("class_counts"))
def q_class_counts_whole(spark, sf_dir):
    from ..operators.profile import class_counts
    c = class_counts(_graded_whole(td.scored(spark, sf_dir)))
    return c.select("llm_classification", "count", r6(F.col("mean_score")).alias("mean_score"),
                    r6(F.col("pct")).alias("pct"))
