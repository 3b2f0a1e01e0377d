"""Queries for sources and sinks.

A round-trip query writes a table derived from the driver's tables into a
fresh folder of the session's shared checkpoint directory, reads it back
with the reader under test, and returns what was read; the oracle is the
table that was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relate
from ..operators.select import select_top_fraction
from ..session import shared_dir
from ..sources import files, records
from ..sources import testdata as td
from .registry import query, r6
from .relations_sql import with_rel

_TRIP = "md5(query_text) AS query_md5, md5(gold_passage) AS gold_md5, md5(hard_negative) AS neg_md5"


@query("read_triplets", with_rel(f"SELECT {_TRIP}, query_text = '   ' AS blank_query FROM DIRTY", "DIRTY"))
def q_read_triplets(spark, sf_dir):
    path = shared_dir(spark, "triplets-tsv")
    files.write_triplets(td.dirty(spark, sf_dir).drop("lang"), path, fmt="tsv")
    back = files.read_triplets(spark, path)
    return back.select(F.md5("query_text").alias("query_md5"), F.md5("gold_passage").alias("gold_md5"),
                       F.md5("hard_negative").alias("neg_md5"), (F.col("query_text") == "   ").alias("blank_query"))


@query("write_triplets", with_rel(f"SELECT lang, {_TRIP} FROM DIRTY", "DIRTY"))
def q_write_triplets(spark, sf_dir):
    path = shared_dir(spark, "triplets-parquet")
    files.write_triplets(td.dirty(spark, sf_dir), path)
    back = files.read_triplets(spark, path, fmt="parquet")
    return back.select("lang", F.md5("query_text").alias("query_md5"), F.md5("gold_passage").alias("gold_md5"),
                       F.md5("hard_negative").alias("neg_md5"))


# --- BEIR layout -----------------------------------------------------------------------------

_BEIR_SQL = """
bq AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, split_part(text, chr(10), 1) AS text, lang FROM documents),
bc AS (SELECT CAST(doc_id AS VARCHAR) AS corpus_id, 'doc ' || CAST(doc_id AS VARCHAR) AS title, text, lang
       FROM documents),
br AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS corpus_id, 1 AS score, lang
       FROM documents WHERE lang <> 'es')"""


def _write_beirset(spark, sf_dir) -> str:
    """BEIRSET: per document a query (its first line), a corpus entry
    and a qrels row; the ``es`` language gets no qrels file."""
    d = td.table(spark, sf_dir, "documents")
    root = shared_dir(spark, "beir")
    ids = F.col("doc_id").cast("string")
    files.write_beir(d.select(ids.alias("query_id"), td.first_line("text").alias("text"), "lang"),
                     d.select(ids.alias("corpus_id"), F.concat(F.lit("doc "), ids).alias("title"), "text", "lang"),
                     d.filter(F.col("lang") != "es").select(ids.alias("query_id"), ids.alias("corpus_id"),
                                                            F.lit(1).alias("score"), "lang"),
                     root)
    return root


@query("read_beir", f"""WITH {_BEIR_SQL}
SELECT r.query_id, r.corpus_id, md5(q.text) AS query_md5, md5(c.text) AS gold_md5
FROM br r JOIN bq q USING (query_id, lang) JOIN bc c USING (corpus_id, lang) WHERE r.lang = 'de'""")
def q_read_beir(spark, sf_dir):
    q, c, r = files.read_beir(spark, _write_beirset(spark, sf_dir), "de")
    j = relate.join_qrels_inner(r, q, c, keep=["query_id", "corpus_id"])
    return j.select("query_id", "corpus_id", F.md5("query_text").alias("query_md5"),
                    F.md5("gold_passage").alias("gold_md5"))


@query("read_beir_multilang", f"""WITH {_BEIR_SQL}
SELECT r.lang, r.query_id, r.corpus_id, md5(q.text) AS query_md5, md5(c.text) AS gold_md5
FROM br r JOIN bq q USING (query_id, lang) JOIN bc c USING (corpus_id, lang)""")
def q_read_beir_multilang(spark, sf_dir):
    q, c, r = files.read_beir_multilang(spark, _write_beirset(spark, sf_dir))
    j = r.join(q.select("query_id", "lang", F.col("text").alias("qt")), ["query_id", "lang"]) \
        .join(c.select("corpus_id", "lang", F.col("text").alias("ct")), ["corpus_id", "lang"])
    return j.select("lang", "query_id", "corpus_id", F.md5("qt").alias("query_md5"), F.md5("ct").alias("gold_md5"))


@query("write_beir", f"""WITH {_BEIR_SQL}
SELECT 'queries' AS dataset, lang, count(*) AS rows FROM bq GROUP BY lang
UNION ALL SELECT 'corpus', lang, count(*) FROM bc GROUP BY lang
UNION ALL SELECT 'qrels', lang, count(*) FROM br GROUP BY lang""")
def q_write_beir(spark, sf_dir):
    q, c, r = files.read_beir(spark, _write_beirset(spark, sf_dir))
    parts = [x.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumn("dataset", F.lit(n))
             for n, x in (("queries", q), ("corpus", c), ("qrels", r))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("dataset", "lang", "rows")


# --- headerless TSV / qrels shapes ----------------------------------------------------------

@query("read_headerless_tsv", with_rel("SELECT query_id, corpus_id FROM BQREL", "BQREL"))
def q_read_headerless_tsv(spark, sf_dir):
    path = shared_dir(spark, "headerless")
    r = td.bench_qrels(spark, sf_dir)
    good = r.select(F.concat_ws("\t", "query_id", "corpus_id").alias("value"))
    bad = r.select(F.concat_ws("\t", "query_id", "corpus_id", F.lit("x"), F.lit("y")).alias("value"))
    good.unionByName(bad).write.mode("overwrite").text(path)
    ok, _rejects = files.read_headerless_tsv(spark, path, ["query_id", "corpus_id"])
    return ok


@query("normalize_qrels", with_rel("""
SELECT v.variant, query_id, corpus_id, CASE WHEN v.variant = 'three' THEN score ELSE 1 END AS score
FROM BQREL, (VALUES ('two'), ('three'), ('trec')) v(variant)""", "BQREL"))
def q_normalize_qrels(spark, sf_dir):
    r = td.bench_qrels(spark, sf_dir)
    root = shared_dir(spark, "qrels")
    r.select("query_id", "corpus_id").write.options(sep="\t").csv(f"{root}/two")
    r.select(F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), "score") \
        .write.options(sep="\t", header="true").csv(f"{root}/three")
    r.select("query_id", F.lit("Q0").alias("q0"), "corpus_id", "score").write.options(sep="\t").csv(f"{root}/trec")
    out = None
    for v, header in (("two", False), ("three", True), ("trec", False)):
        x = files.normalize_qrels(spark, f"{root}/{v}", header).withColumn("variant", F.lit(v))
        out = x if out is None else out.unionByName(x)
    return out.select("variant", "query_id", "corpus_id", "score")


@query("read_tsv_eval_sources", with_rel("""
SELECT DISTINCT md5(q.text) AS query_md5, md5(p.text) AS gold_md5
FROM BQREL r LEFT JOIN BQ q USING (query_id) LEFT JOIN PASS p USING (corpus_id)
WHERE q.text IS NOT NULL AND p.text IS NOT NULL""", "BQREL"))
def q_read_tsv_eval_sources(spark, sf_dir):
    root = shared_dir(spark, "tsv-eval")
    opts = {**files._CSV, "quoteAll": "true"}
    td.bench_queries(spark, sf_dir).select("query_id", F.lit("").alias("title"), "text") \
        .write.options(**opts).csv(f"{root}/queries")
    td.passages(spark, sf_dir).select("corpus_id", F.lit("").alias("title"), "text") \
        .write.options(**opts).csv(f"{root}/corpus")
    td.bench_qrels(spark, sf_dir).write.options(**opts).csv(f"{root}/qrels")
    q, c, r = files.read_tsv_eval_sources(spark, f"{root}/queries", f"{root}/corpus", f"{root}/qrels")
    j = relate.join_qrels_left(r, q.select("query_id", F.col("query_text").alias("text")),
                               c.select("corpus_id", F.col("passage").alias("text")))
    return j.select(F.md5("query").alias("query_md5"), F.md5("passage").alias("gold_md5"))


# --- nested records -------------------------------------------------------------------------

_FIRST_TURNS = """
fp AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') AS pt,
              min(turn) FILTER (WHERE role = 'system') AS nt, min(turn) FILTER (WHERE role = 'user') AS ut
       FROM conversations GROUP BY conv_id)"""


@query("flatten_train_records", f"""WITH {_FIRST_TURNS}
SELECT CAST(f.conv_id AS VARCHAR) AS query_id, md5(u.text) AS query_md5,
       'turn ' || CAST(f.pt AS VARCHAR) AS title,
       md5('turn ' || CAST(f.pt AS VARCHAR) || ' ' || p.text) AS gold_md5,
       md5(coalesce('turn ' || CAST(f.nt AS VARCHAR) || ' ' || n.text, '')) AS neg_md5
FROM fp f LEFT JOIN conversations u ON u.conv_id = f.conv_id AND u.turn = f.ut
LEFT JOIN conversations p ON p.conv_id = f.conv_id AND p.turn = f.pt
LEFT JOIN conversations n ON n.conv_id = f.conv_id AND n.turn = f.nt""")
def q_flatten_train_records(spark, sf_dir):
    flat = records.flatten_train_records(td.nested(spark, sf_dir))
    return flat.select("query_id", F.md5("query_text").alias("query_md5"), "title",
                       F.md5("gold_passage").alias("gold_md5"), F.md5("hard_negative").alias("neg_md5"))


@query("qrels_from_records", f"""WITH {_FIRST_TURNS}
SELECT CAST(conv_id AS VARCHAR) AS query_id, CAST(conv_id AS VARCHAR) || '-' || CAST(pt AS VARCHAR) AS corpus_id,
       1 AS score FROM fp WHERE pt IS NOT NULL""")
def q_qrels_from_records(spark, sf_dir):
    return records.qrels_from_records(td.nested(spark, sf_dir))


@query("explode_qrels", """
SELECT CAST(conv_id AS VARCHAR) AS query_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS corpus_id,
       1 AS score FROM conversations WHERE role = 'assistant'""")
def q_explode_qrels(spark, sf_dir):
    n = td.nested(spark, sf_dir).select(F.col("query_id").alias("id"),
                                         F.transform("positive_passages", lambda p: p["docid"]).alias("article_ids"))
    return records.explode_qrels(n)


@query("queries_from_records", "SELECT CAST(item_id AS VARCHAR) AS _id, text FROM benchmark")
def q_queries_from_records(spark, sf_dir):
    return records.queries_from_records(td.table(spark, sf_dir, "benchmark"))


_LANGS = ["de", "fr", "es", "en"]


@query("replicate_qrels", with_rel("""
SELECT l.lang, query_id, corpus_id, score FROM BQREL, (VALUES ('de'), ('fr'), ('es'), ('en')) l(lang)""", "BQREL"))
def q_replicate_qrels(spark, sf_dir):
    return records.replicate_qrels(td.bench_qrels(spark, sf_dir), _LANGS).select("lang", "query_id", "corpus_id",
                                                                                 "score")


# --- other sinks --------------------------------------------------------------------------

@query("write_scored_and_selected", with_rel("""
SELECT 'all' AS which, lang, md5(query_text) AS query_md5, md5(hard_negative) AS neg_md5, round(rag_score, 6) AS rag_score
FROM SCORED
UNION ALL
SELECT 'selected', lang, md5(query_text), md5(hard_negative), round(rag_score, 6)
FROM SCORED WHERE rag_score >= (SELECT quantile_cont(rag_score, 0.5) FROM SCORED)""", "SCORED"))
def q_write_scored_and_selected(spark, sf_dir):
    a, b = files.write_scored_and_selected(td.scored(spark, sf_dir), shared_dir(spark, "selection"),
                                           lambda written: select_top_fraction(written, 0.5)[0])
    out = None
    for which, p in (("all", a), ("selected", b)):
        x = spark.read.parquet(p).select(F.lit(which).alias("which"), "lang", F.md5("query_text").alias("query_md5"),
                                         F.md5("hard_negative").alias("neg_md5"), r6(F.col("rag_score")).alias("rag_score"))
        out = x if out is None else out.unionByName(x)
    return out


@query("write_metrics_json", with_rel("""
SELECT setting, lang AS model, metric, round(value, 6) AS value FROM (
  SELECT setting, lang, unnest(['rows', 'avg_len']) AS metric, unnest([count(*), avg(length(passage))]) AS value
  FROM LANGEVAL GROUP BY setting, lang)""", "LANGEVAL"))
def q_write_metrics_json(spark, sf_dir):
    le = td.lang_eval(spark, sf_dir)
    stats = le.groupBy("setting", F.col("lang").alias("model")).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.avg(F.length("passage")).alias("avg_len"))
    long = stats.selectExpr("setting", "model", "stack(2, 'rows', rows, 'avg_len', avg_len) as (metric, value)")
    path = shared_dir(spark, "metrics-json")
    files.write_metrics_json(long, path)
    back = spark.read.schema("setting string, model string, metrics string").json(path)
    m = back.select("setting", "model", F.explode(F.from_json("metrics", "map<string,double>")).alias("metric", "value"))
    return m.select("setting", "model", "metric", r6(F.col("value")).alias("value"))


@query("eval_cache", with_rel("""
SELECT setting, lang, md5(query) AS query_md5, md5(passage) AS passage_md5 FROM LANGEVAL""", "LANGEVAL"))
def q_eval_cache(spark, sf_dir):
    path = shared_dir(spark, "eval-cache")
    documents = td.table(spark, sf_dir, "documents")
    files.eval_cache(spark, path, lambda: td.lang_eval(spark, sf_dir), setting="all", source=documents)  # miss: build and write

    def must_not_build():
        raise RuntimeError("cache present but rebuilt")
    again = files.eval_cache(spark, path, must_not_build, setting="all", source=documents)  # hit: read back
    return again.select("setting", "lang", F.md5("query").alias("query_md5"), F.md5("passage").alias("passage_md5"))


@query("write_eval_csv_by_lang", with_rel("""
SELECT setting, lang, count(*) AS rows, count(*) AS rows_read FROM LANGEVAL GROUP BY setting, lang""", "LANGEVAL"))
def q_write_eval_csv_by_lang(spark, sf_dir):
    path = shared_dir(spark, "eval-csv")
    counts = files.write_eval_csv_by_lang(td.lang_eval(spark, sf_dir), path)
    back = spark.read.options(header="true", escape='"', multiLine="true").csv(path) \
        .groupBy("setting", "lang").agg(F.count(F.lit(1)).alias("rows_read"))
    return counts.join(back, ["setting", "lang"], "full")


@query("write_vectors", with_rel("""
SELECT count(*) AS corpus_size, max(len(embedding)) AS dim, count(*) AS rows_read FROM VEC""", "VEC"))
def q_write_vectors(spark, sf_dir):
    path = shared_dir(spark, "vectors")
    files.write_vectors(td.vectors(spark, sf_dir), path)
    meta = spark.read.parquet(f"{path}/metadata")
    n = spark.read.parquet(f"{path}/vectors").agg(F.count(F.lit(1)).alias("rows_read"))
    return meta.withColumn("rows_read", F.lit(n.first()["rows_read"]))
