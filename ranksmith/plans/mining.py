"""Queries: corpus building, BM25 statistics, top-k and hard-negative mining."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions import rank as R
from ..operators import bm25, clean
from ..sources import testdata as td
from .registry import query, r6
from .relations_sql import strip_sql, tok_sql, with_rel

# --- shared SQL pieces -------------------------------------------------------

_CLEAN_PAIRS = f"""
cleaned AS (SELECT DISTINCT conv_id, turn, query_text, gold_passage FROM PAIRS
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND query_text IS NOT NULL
    AND gold_passage IS NOT NULL
    AND {strip_sql('query_text')} <> '' AND {strip_sql('gold_passage')} <> ''
    AND length(query_text) BETWEEN 10 AND 512 AND length(gold_passage) BETWEEN 20 AND 2048)"""

_INDEX = f"""
corpus AS (SELECT DISTINCT gold_passage AS passage FROM cleaned),
dtok AS (SELECT passage, {tok_sql('passage')} AS toks FROM corpus),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM dtok),
post AS (SELECT passage, dl, term, count(*) AS tf
         FROM (SELECT passage, len(toks) AS dl, unnest(toks) AS term FROM dtok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf_raw FROM dfs, stats),
terms AS (SELECT term, df, CASE WHEN idf_raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(idf_raw) FROM raw)
                           ELSE idf_raw END AS idf FROM raw),
w AS (SELECT p.passage, p.term, p.tf,
             t.idf * p.tf * CAST(2.5 AS DOUBLE)
               / (p.tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * p.dl / s.avgdl)) AS weight
      FROM post p JOIN terms t USING (term), stats s),
qs AS (SELECT DISTINCT query_text, gold_passage FROM cleaned),
qt AS (SELECT query_text, gold_passage, term, count(*) AS qtf
       FROM (SELECT query_text, gold_passage, unnest({tok_sql('query_text')}) AS term FROM qs) GROUP BY ALL),
sc AS (SELECT qt.query_text, qt.gold_passage, w.passage, sum(qt.qtf * w.weight) AS score
       FROM qt JOIN w USING (term) GROUP BY ALL)"""


def _cleaned_pairs(spark, sf_dir):
    """Cleaned conversation pairs; read several times per query, so kept."""
    return clean.clean_dataset(td.pairs(spark, sf_dir), negative=None).persist(StorageLevel.MEMORY_AND_DISK)


def _index(cleaned):
    return bm25.bm25_index(bm25.build_corpus(cleaned, cols=["gold_passage"]))


def _named_queries(cleaned):
    """Distinct (query, gold) pairs, named by their digests."""
    return cleaned.select("query_text", "gold_passage").distinct().select(
        F.md5("query_text").alias("query_md5"), F.md5("gold_passage").alias("gold_md5"), "query_text")


# --- queries -----------------------------------------------------------------

@query("bm25_hard_negatives", with_rel(f"""
WITH {_CLEAN_PAIRS},{_INDEX},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_text, gold_passage
                                        ORDER BY round(score, 9) DESC, passage) AS rn
           FROM sc WHERE passage <> gold_passage),
pads AS (SELECT passage, row_number() OVER (ORDER BY md5(passage), passage) AS pn FROM corpus),
mined AS (SELECT q.query_text, q.gold_passage,
                 coalesce(r.passage, (SELECT p.passage FROM pads p WHERE p.passage <> q.gold_passage
                                      ORDER BY p.pn LIMIT 1)) AS hard_negative
          FROM qs q LEFT JOIN ranked r
            ON r.query_text = q.query_text AND r.gold_passage = q.gold_passage AND r.rn = 1)
SELECT c.conv_id, c.turn, c.query_text, c.gold_passage, m.hard_negative
FROM cleaned c JOIN mined m USING (query_text, gold_passage)""", "PAIRS"))
def q_bm25_hard_negatives(spark, sf_dir):
    cleaned = _cleaned_pairs(spark, sf_dir)
    return bm25.bm25_hard_negatives(cleaned, n=1).select(
        "conv_id", "turn", "query_text", "gold_passage", "hard_negative")


@query("build_corpus", with_rel("""
SELECT DISTINCT passage FROM (
  SELECT gold_passage AS passage FROM DIRTY UNION ALL SELECT hard_negative FROM DIRTY)
WHERE passage IS NOT NULL""", "DIRTY"))
def q_build_corpus(spark, sf_dir):
    return bm25.build_corpus(td.dirty(spark, sf_dir))


@query("bm25_doc_stats", with_rel(f"""
WITH {_CLEAN_PAIRS},{_INDEX}
SELECT md5(d.passage) AS passage_md5, CAST(len(d.toks) AS BIGINT) AS dl,
       s.n_docs, round(s.avgdl, 6) AS avgdl
FROM dtok d, stats s""", "PAIRS"))
def q_bm25_doc_stats(spark, sf_dir):
    idx = _index(_cleaned_pairs(spark, sf_dir))
    st = idx.stats.first()  # one row: the pooled corpus
    return idx.doc_stats.join(idx.corpus, ["pid", "pid2"]).select(
        F.md5("passage").alias("passage_md5"), "dl", F.lit(st["n_docs"]).alias("n_docs"),
        r6(F.lit(st["avgdl"])).alias("avgdl"))


@query("bm25_postings", with_rel(f"""
WITH {_CLEAN_PAIRS},{_INDEX}
SELECT md5(passage) AS passage_md5, term, tf FROM post""", "PAIRS"))
def q_bm25_postings(spark, sf_dir):
    idx = _index(_cleaned_pairs(spark, sf_dir))
    p = idx.postings.join(idx.corpus, ["pid", "pid2"])
    return p.select(F.md5("passage").alias("passage_md5"), "term", "tf")


@query("bm25_idf", with_rel(f"""
WITH {_CLEAN_PAIRS},{_INDEX}
SELECT term, df, round(idf, 6) AS idf FROM terms""", "PAIRS"))
def q_bm25_idf(spark, sf_dir):
    idx = _index(_cleaned_pairs(spark, sf_dir))
    return idx.terms.select("term", "df", r6(F.col("idf")).alias("idf"))


@query("bm25_scores", with_rel(f"""
WITH {_CLEAN_PAIRS},{_INDEX}
SELECT md5(query_text) AS query_md5, md5(gold_passage) AS gold_md5, md5(passage) AS passage_md5,
       round(score, 6) AS score
FROM sc""", "PAIRS"))
def q_bm25_scores(spark, sf_dir):
    cleaned = _cleaned_pairs(spark, sf_dir)
    idx = _index(cleaned)
    s = bm25.bm25_scores(idx, _named_queries(cleaned), ["query_md5", "gold_md5"], "query_text", label=F.md5("passage"))
    return s.select("query_md5", "gold_md5", F.col("label").alias("passage_md5"), r6(F.col("score")).alias("score"))


@query("bm25_topk", with_rel(f"""
WITH {_CLEAN_PAIRS},{_INDEX},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_text, gold_passage
                                        ORDER BY round(score, 9) DESC, passage) AS rn FROM sc)
SELECT md5(query_text) AS query_md5, md5(gold_passage) AS gold_md5, CAST(rn AS INTEGER) AS rank,
       md5(passage) AS passage_md5, round(score, 6) AS score
FROM ranked WHERE rn <= 100""", "PAIRS"))
def q_bm25_topk(spark, sf_dir):
    cleaned = _cleaned_pairs(spark, sf_dir)
    idx = _index(cleaned)
    t = bm25.bm25_topk(idx, _named_queries(cleaned), ["query_md5", "gold_md5"], "query_text", k=100, label=F.md5("passage"))
    return t.select("query_md5", "gold_md5", F.col("rank").cast("int"), F.col("label").alias("passage_md5"),
                    r6(F.col("score")).alias("score"))


@query("rrank_gain", with_rel(f"""
WITH {_CLEAN_PAIRS},{_INDEX},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_text, gold_passage
                                        ORDER BY round(score, 9) DESC, passage) AS rn FROM sc)
SELECT md5(query_text) AS query_md5, md5(gold_passage) AS gold_md5, md5(passage) AS passage_md5, CAST(rn AS BIGINT) AS rank,
       round(CASE WHEN rn <= 10 THEN 1.0 / rn ELSE 0.0 END, 6) AS rr,
       round(CASE WHEN rn <= 10 THEN 1.0 / log2(1 + rn) ELSE 0.0 END, 6) AS gain,
       CAST(CASE WHEN rn <= 1 THEN 1 ELSE 0 END AS DOUBLE) AS hit1,
       CAST(CASE WHEN rn <= 5 THEN 1 ELSE 0 END AS DOUBLE) AS hit5,
       CAST(CASE WHEN rn <= 10 THEN 1 ELSE 0 END AS DOUBLE) AS hit10
FROM ranked WHERE rn <= 15""", "PAIRS"))
def q_rrank_gain(spark, sf_dir):
    """Gains of the first ranks of a BM25 ranking."""
    cleaned = _cleaned_pairs(spark, sf_dir)
    t = bm25.bm25_topk(_index(cleaned), _named_queries(cleaned), ["query_md5", "gold_md5"], "query_text", k=15, label=F.md5("passage"))
    return t.select("query_md5", "gold_md5", F.col("label").alias("passage_md5"),
                    F.col("rank").cast("long").alias("rank"), r6(R.reciprocal_rank("rank")).alias("rr"),
                    r6(R.dcg_gain("rank")).alias("gain"), R.hit_at("rank", 1).alias("hit1"),
                    R.hit_at("rank", 5).alias("hit5"), R.hit_at("rank", 10).alias("hit10"))


def bm25_mine_sql(corpus_sql: str, qs_sql: str) -> str:
    """CTE chain (no WITH) ending in ``mined(_scope, query_text, gold_passage,
    mined)``: BM25 over ``corpus_sql`` (``_scope, passage``), first negative
    for every distinct row of ``qs_sql`` (``_scope, query_text,
    gold_passage``), padded by the smallest (md5, text) corpus text."""
    return f"""
corpus AS ({corpus_sql}),
dtok AS (SELECT _scope, passage, {tok_sql('passage')} AS toks FROM corpus),
stats AS (SELECT _scope, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM dtok GROUP BY _scope),
post AS (SELECT _scope, passage, dl, term, count(*) AS tf
         FROM (SELECT _scope, passage, len(toks) AS dl, unnest(toks) AS term FROM dtok) GROUP BY ALL),
dfs AS (SELECT _scope, term, count(*) AS df FROM post GROUP BY ALL),
raw AS (SELECT d._scope, term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf_raw
        FROM dfs d JOIN stats s USING (_scope)),
avgi AS (SELECT _scope, avg(idf_raw) AS a FROM raw GROUP BY _scope),
terms AS (SELECT r._scope, term, df, CASE WHEN idf_raw < 0 THEN CAST(0.25 AS DOUBLE) * a ELSE idf_raw END AS idf
          FROM raw r JOIN avgi USING (_scope)),
w AS (SELECT p._scope, p.passage, p.term, p.tf,
             t.idf * p.tf * CAST(2.5 AS DOUBLE)
               / (p.tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * p.dl / s.avgdl)) AS weight
      FROM post p JOIN terms t USING (_scope, term) JOIN stats s USING (_scope)),
qs AS (SELECT DISTINCT _scope, query_text, gold_passage FROM ({qs_sql})),
qt AS (SELECT _scope, query_text, gold_passage, term, count(*) AS qtf
       FROM (SELECT _scope, query_text, gold_passage, unnest({tok_sql('query_text')}) AS term FROM qs) GROUP BY ALL),
sc AS (SELECT qt._scope, qt.query_text, qt.gold_passage, w.passage, sum(qt.qtf * w.weight) AS score
       FROM qt JOIN w USING (_scope, term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY _scope, query_text, gold_passage
                                        ORDER BY round(score, 9) DESC, passage) AS rn
           FROM sc WHERE passage <> gold_passage),
ranked_all AS (SELECT *, row_number() OVER (PARTITION BY _scope, query_text, gold_passage
                                            ORDER BY round(score, 9) DESC, passage) AS rn FROM sc),
pads AS (SELECT _scope, passage, row_number() OVER (PARTITION BY _scope ORDER BY md5(passage), passage) AS pn
         FROM corpus),
mined AS (SELECT q._scope, q.query_text, q.gold_passage,
                 coalesce(r.passage, (SELECT p.passage FROM pads p WHERE p._scope = q._scope
                                      AND p.passage <> q.gold_passage ORDER BY p.pn LIMIT 1)) AS mined
          FROM qs q LEFT JOIN ranked r ON r._scope = q._scope AND r.query_text = q.query_text
                                      AND r.gold_passage = q.gold_passage AND r.rn = 1)"""
