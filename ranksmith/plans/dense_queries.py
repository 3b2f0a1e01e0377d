"""Queries for dense retrieval and the rank tables that the
evaluation queries (§2.8) aggregate.

Vector models over ``embeddings``: every vector is a query, the corpus all
vectors, and a query never finds itself; models score the cosine of vectors whose
i-th number is weighted by a power of i: 0 for A, -1/2 for B, 1/2 for C.  The
gold passage of a query (VECQ) is its nearest corpus vector with power 1/4.

Text models over LANGEVAL: the offline hashed bag-of-words encoder with 64
(``bow64``) or 32 (``bow32``) buckets, corpus = distinct passages of the
same setting and language.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import dense, dense_index
from ..session import staged
from ..sources import testdata as td
from .registry import query, r6
from .relations_sql import tok_sql, with_rel

# The power of its position that weights each dimension.
MODEL_POWERS = [("A", 0.0), ("B", -0.5), ("C", 0.5)]
GOLD_POWER = 0.25
TEXT_MODELS = [("bow64", 64), ("bow32", 32)]


def _weighted(col, power):
    return V.normalize_vector(F.transform(col, lambda x, i: x * F.pow((i + 1).cast("double"), power)))


def vec_split(spark, sf_dir):
    """Queries and corpus: both are all vectors."""
    v = td.vectors(spark, sf_dir)
    return v, v


def vec_gold(spark, sf_dir):
    """VECQ: (query_id, gold_id) -- nearest corpus vector with GOLD_POWER."""
    q, p = vec_split(spark, sf_dir)
    t = dense.dense_topk(q.select(F.col("vec_id").alias("query_id"), _weighted("embedding", F.lit(GOLD_POWER)).alias("qvec")),
                         p.select(F.col("vec_id").alias("gold_id"), _weighted("embedding", F.lit(GOLD_POWER)).alias("pvec")),
                         k=1, qid="query_id", pid="gold_id", other_than_self=True)
    return t.select("query_id", "gold_id")


def vec_models(spark, sf_dir):
    """(queries, corpus) for models A/B/C with a ``model`` scope column."""
    q, p = vec_split(spark, sf_dir)
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(e).alias("power"))
                                 for m, e in MODEL_POWERS])).alias("m")

    def per_model(df, idname, vname):
        x = df.select("vec_id", "embedding", models).select("vec_id", "embedding", "m.*")
        return x.select("model", F.col("vec_id").alias(idname),
                        _weighted("embedding", F.col("power")).alias(vname))

    qs = per_model(q, "query_id", "qvec").join(vec_gold(spark, sf_dir), "query_id")
    return qs, per_model(p, "passage_id", "pvec")


_VEC_SQL = """
VQ AS (SELECT vec_id, embedding FROM VEC),
VP AS (SELECT vec_id, embedding FROM VEC),
M AS (SELECT * FROM (VALUES ('A', 0.0::DOUBLE), ('B', -0.5), ('C', 0.5), ('gold', 0.25)) t(model, power)),
QV AS (SELECT m.model, q.vec_id AS query_id, list_transform(q.embedding, lambda x, i: x * pow(i, m.power)) AS v FROM VQ q, M m),
PV AS (SELECT m.model, p.vec_id AS passage_id, list_transform(p.embedding, lambda x, i: x * pow(i, m.power)) AS v FROM VP p, M m),
S0 AS (SELECT q.model, q.query_id, p.passage_id,
             list_sum(list_transform(list_zip(q.v, p.v), lambda x: x[1] * x[2]))
               / (sqrt(list_sum(list_transform(q.v, lambda x: x * x)))
                  * sqrt(list_sum(list_transform(p.v, lambda x: x * x)))) AS score
      FROM QV q JOIN PV p ON q.model = p.model AND q.query_id <> p.passage_id),
G AS (SELECT query_id, passage_id AS gold_id, round(score, 9) AS s FROM S0 WHERE model = 'gold'),
VECQ AS (SELECT query_id, gold_id FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, gold_id) AS rn FROM G) WHERE rn = 1),
S AS (SELECT * FROM S0 WHERE model <> 'gold'),
R AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY round(score, 9) DESC, passage_id) AS rank
      FROM S)"""


def vec_sql(body: str) -> str:
    return with_rel(f"WITH {_VEC_SQL}\n{body}", "VEC")


#: Vectors of a block: small, as the test tables are.
BLOCK_ROWS = 64


def _indexed(spark, sf_dir):
    """Queries, corpus and its index; the corpus is read from the index."""
    qs, ps = vec_models(spark, sf_dir)
    index = dense_index.cluster_index(ps, "passage_id", "pvec", ["model"], BLOCK_ROWS)
    if index is not None:
        ps = index.vectors.select("model", F.col("_id").alias("passage_id"), F.col("_vec").alias("pvec"))
    return staged(qs, "model-queries"), ps, index


def vec_search(spark, sf_dir, k=10):
    """The queries with their golds, and their top ``k``."""
    qs, ps, index = _indexed(spark, sf_dir)
    return qs, dense.dense_topk(qs, ps, k=k, qid="query_id", pid="passage_id", scope=["model"], index=index, other_than_self=True)


def vec_topk(spark, sf_dir, k=10):
    return vec_search(spark, sf_dir, k)[1]


def vec_gold_ranks(spark, sf_dir):
    qs, ps, index = _indexed(spark, sf_dir)
    return dense.gold_rank_full(qs, ps, qid="query_id", gold="gold_id", pid="passage_id", scope=["model"], index=index,
                                other_than_self=True)


# --- text (LANGEVAL) models -------------------------------------------------------------

def _encode(df, text, dim, keep):
    return dense.embed_pass(df, text, dense.hashed_bow_encoder(dim), out="vec", keep=keep).replies


def text_models(spark, sf_dir):
    """(units, queries, corpus) for the bow models; ids are md5 of text.
    Texts are encoded where they are; what is made distinct, written and moved
    are their ids and vectors."""
    le = td.lang_eval(spark, sf_dir).withColumns({"qid": F.md5("query"), "pid": F.md5("passage")})
    units = le.select("setting", "lang", "qid", F.col("pid").alias("gold_pid"))
    own = ["setting", "lang"]
    qs, ps = [], []
    for name, dim in TEXT_MODELS:
        q = _encode(le.select(*own, "qid", "query"), "query", dim, [*own, "qid"]).distinct()
        p = dense.unique_passages(_encode(le.select(*own, "pid", "passage"), "passage", dim, [*own, "pid"]), "pid", [*own, "vec"])
        qs.append(q.select(F.lit(name).alias("model"), *own, "qid", F.col("vec").alias("qvec")))
        ps.append(p.select(F.lit(name).alias("model"), *own, "pid", F.col("vec").alias("pvec")))
    q, p = qs[0], ps[0]
    for x in qs[1:]:
        q = q.unionByName(x)
    for x in ps[1:]:
        p = p.unionByName(x)
    return units, q, p


def text_topk(spark, sf_dir, k=10):
    units, q, p = text_models(spark, sf_dir)
    return units, dense.dense_topk(q, p, k=k, scope=["model", "setting", "lang"])


_TEXT_SQL = f"""
TM AS (SELECT * FROM (VALUES ('bow64', 64), ('bow32', 32)) t(model, dim)),
UNITS AS (SELECT setting, lang, md5(query) AS qid, md5(passage) AS gold_pid FROM LANGEVAL),
PT AS (SELECT DISTINCT setting, lang, passage FROM LANGEVAL WHERE passage IS NOT NULL),
QT AS (SELECT DISTINCT setting, lang, query FROM LANGEVAL),
PB AS (SELECT model, setting, lang, md5(passage) AS pid,
              CAST(('0x' || substr(md5(t), 1, 8)) AS UBIGINT) % dim AS b, count(*) AS c
       FROM (SELECT setting, lang, passage, unnest({tok_sql('passage')}) AS t FROM PT), TM GROUP BY ALL),
QB AS (SELECT model, setting, lang, md5(query) AS qid,
              CAST(('0x' || substr(md5(t), 1, 8)) AS UBIGINT) % dim AS b, count(*) AS c
       FROM (SELECT setting, lang, query, unnest({tok_sql('query')}) AS t FROM QT), TM GROUP BY ALL),
PW AS (SELECT model, setting, lang, pid, b, c / sqrt(sum(c * c) OVER (PARTITION BY model, setting, lang, pid)) AS w FROM PB),
QW AS (SELECT model, setting, lang, qid, b, c / sqrt(sum(c * c) OVER (PARTITION BY model, setting, lang, qid)) AS w FROM QB),
DOT AS (SELECT q.model, q.setting, q.lang, q.qid, p.pid, sum(q.w * p.w) AS score
        FROM QW q JOIN PW p ON q.model = p.model AND q.setting = p.setting AND q.lang = p.lang AND q.b = p.b
        GROUP BY ALL),
PAIRS2 AS (SELECT tm.model, q.setting, q.lang, md5(q.query) AS qid, md5(p.passage) AS pid
           FROM QT q JOIN PT p ON q.setting = p.setting AND q.lang = p.lang, TM tm),
TS AS (SELECT x.model, x.setting, x.lang, x.qid, x.pid, coalesce(d.score, 0.0) AS score
       FROM PAIRS2 x LEFT JOIN DOT d USING (model, setting, lang, qid, pid)),
TR AS (SELECT *, row_number() OVER (PARTITION BY model, setting, lang, qid ORDER BY round(score, 9) DESC, pid) AS rank
       FROM TS)"""


def text_sql(body: str) -> str:
    return with_rel(f"WITH {_TEXT_SQL}\n{body}", "LANGEVAL")


# --- queries ------------------------------------------------------------------------------

@query("dense_topk", vec_sql("""
SELECT model, query_id, CAST(rank AS INTEGER) AS rank, passage_id, round(score, 6) AS score FROM R WHERE rank <= 10"""))
def q_dense_topk(spark, sf_dir):
    t = vec_topk(spark, sf_dir, 10)
    return t.select("model", "query_id", F.col("rank").cast("int"), "passage_id", r6(F.col("score")).alias("score"))


@query("gold_rank_full", vec_sql("""
SELECT r.model, r.query_id, CAST(r.rank AS BIGINT) AS rank
FROM R r JOIN VECQ g ON r.query_id = g.query_id AND r.passage_id = g.gold_id"""))
def q_gold_rank_full(spark, sf_dir):
    return vec_gold_ranks(spark, sf_dir).select("model", "query_id", F.col("rank").cast("long"))


@query("gold_rank_topk", vec_sql("""
SELECT q.model, q.query_id, CAST(r.rank AS INTEGER) AS rank
FROM (SELECT DISTINCT model, query_id FROM R) q JOIN VECQ g USING (query_id)
LEFT JOIN R r ON r.model = q.model AND r.query_id = q.query_id AND r.passage_id = g.gold_id AND r.rank <= 10"""))
def q_gold_rank_topk(spark, sf_dir):
    from ..operators.evaluate import gold_rank_topk
    qs, t = vec_search(spark, sf_dir, 10)
    t = t.select("model", "query_id", F.col("passage_id").alias("passage"), "rank")
    r = gold_rank_topk(t, qs.select("model", "query_id", "gold_id"), ["model", "query_id"], "gold_id")
    return r.select("model", "query_id", F.col("rank").cast("int"))


@query("score_all_pairs", vec_sql("""
SELECT model, query_id, count(*) AS n_scored, round(sum(score / (1 + 1e-8)), 6) AS score_sum,
       round(max(score / (1 + 1e-8)), 6) AS score_max
FROM S GROUP BY model, query_id"""))
def q_score_all_pairs(spark, sf_dir):
    qs, ps = vec_models(spark, sf_dir)
    s = dense.score_all_pairs(qs, ps, qid="query_id", pid="passage_id", scope=["model"], other_than_self=True, eps=1e-8)
    return s.select("model", "query_id", "n_scored", r6(F.col("score_sum")).alias("score_sum"),
                    r6(F.col("score_max")).alias("score_max"))


@query("index_metadata", vec_sql("""
SELECT m.model, count(*) AS corpus_size, max(len(VP.embedding)) AS dim FROM VP, M m WHERE m.model <> 'gold' GROUP BY m.model"""))
def q_index_metadata(spark, sf_dir):
    _, ps = vec_models(spark, sf_dir)
    return ps.groupBy("model").agg(F.count(F.lit(1)).alias("corpus_size"), F.max(F.size("pvec")).alias("dim"))


@query("unique_passages", with_rel("""
SELECT DISTINCT setting, lang, md5(passage) AS passage_md5 FROM LANGEVAL WHERE passage IS NOT NULL""", "LANGEVAL"))
def q_unique_passages(spark, sf_dir):
    u = dense.unique_passages(td.lang_eval(spark, sf_dir), "passage", keys=["setting", "lang"])
    return u.select("setting", "lang", F.md5("passage").alias("passage_md5"))


@query("embed_batches", text_sql("""
SELECT model, setting, lang, pid AS passage_md5, CAST(b AS INTEGER) AS bucket, round(w, 6) AS value FROM PW"""))
def q_embed_batches(spark, sf_dir):
    _, _, p = text_models(spark, sf_dir)
    e = p.select("model", "setting", "lang", F.col("pid").alias("passage_md5"),
                 F.posexplode("pvec").alias("bucket", "value")).filter(F.col("value") != 0)
    return e.select("model", "setting", "lang", "passage_md5", F.col("bucket").cast("int"),
                    r6(F.col("value")).alias("value"))


@query("context_topk", text_sql("""
SELECT model, setting, lang, qid, CAST(rank AS INTEGER) AS rank, pid, round(score, 6) AS score
FROM TR WHERE rank <= 5 AND model = 'bow64'"""))
def q_context_topk(spark, sf_dir):
    units, q, p = text_models(spark, sf_dir)
    q, p = q.filter(F.col("model") == "bow64"), p.filter(F.col("model") == "bow64")
    t = dense.dense_topk(q, p, k=5, scope=["model", "setting", "lang"])
    ctx = t.groupBy("model", "setting", "lang", "qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "pid", "score"))).alias("contexts"))
    return ctx.select("model", "setting", "lang", "qid", F.explode("contexts").alias("c")).select(
        "model", "setting", "lang", "qid", F.col("c.rank").cast("int").alias("rank"), F.col("c.pid").alias("pid"),
        r6(F.col("c.score")).alias("score"))
