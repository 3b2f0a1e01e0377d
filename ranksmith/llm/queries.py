"""Queries that apply each operator to its whole table, and the SQL that says
the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.session import shared_dir

from . import (bpe, centroids, chat, exact_dedup, langid, lexical, main_text, mixing, quality, sharding, simhash, token_counts,
               toxicity)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 512


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def bpe_rows(docs: DataFrame) -> DataFrame:
    """The digests of a round trip: ids and decoded text are hashed by Spark."""
    both = bpe.round_trip(docs.select("doc_id", "text"), vocabulary())
    return both.select("doc_id", bpe.n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@_query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_rows(read(spark, sf_dir, "documents"))


@_query("op2_kd_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op3_chat_snapshots", r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations),
p AS (SELECT conv_id, pos, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos) AS chat FROM t),
e AS (SELECT min(conv_id) AS conv_id, n, count(*) AS copies, chat FROM p WHERE pos = n GROUP BY n, chat)
SELECT conv_id, 0::BIGINT AS part, n AS n_turns, copies, chat FROM e
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.chat = e.chat AND p.pos = e.n AND p.n > e.n)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


@_query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary(), shared_dir(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@_query("op5_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s),
w AS (SELECT *, (nth - 1) % 3 + 1 AS weight, 3 * source_size AS stop, 3.0::DOUBLE * source_size / ((nth - 1) % 3 + 1) AS ratio FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, nth LIMIT 1),
p AS (SELECT source, source_size, least((SELECT level FROM f) * weight, stop::DOUBLE) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p),
c AS (SELECT d.source, hash, sum(size) AS held, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY hash) AS cum
      FROM d WHERE size > 0 GROUP BY d.source, hash),
o AS (SELECT c.*, target - whole * source_size AS budget FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source),
x AS (SELECT source, hash AS edge, cum, held, budget FROM o WHERE cum > budget
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY hash) = 1),
t AS (SELECT source, CASE WHEN cum - budget < budget - (cum - held) THEN edge ELSE edge - 1 END AS threshold FROM x WHERE budget > 0)
SELECT d.doc_id, d.size, q.source_size, round(q.target, 6) AS target,
       (d.size * (q.whole + CASE WHEN hash <= t.threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_query("op6_simhash_balls")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op7_toxic_sentences")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.located(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score",
                                                (F.col("score") >= 0.5).cast("int").alias("predicted"),
                                                "n_offending", "worst_start", "worst_stop")


@_query("op8_chunk_recipes", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op9_quality_ratio")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ratios = quality.fit(docs, quality.trusted_ids(read(spark, sf_dir, "labels")))
    return quality.score(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                              "base_failed", "kept", "score")


@_query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, vocabulary(PIECES))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query("op11_main_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(read(spark, sf_dir, "pages"))


@_query("op12_ranked_search", r"""
WITH words AS (
  SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT r, 75 + (25 * n * docs) // terms AS m FROM n, c),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
q AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _centroid_sql(k: int, rounds: int, seed: int) -> str:
    """The rounds written out: ``a<i>`` assigns, ``c<i + 1>`` moves."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
    SELECT v.r, v.vec_id, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM v, c{i} c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT a.c, i, sum(x)::HUGEINT AS s, count(*) AS n
      FROM a{i} a JOIN (SELECT r, unnest(v) AS x, unnest(range(64)) AS i FROM v) v USING (r) GROUP BY a.c, i) GROUP BY c) m USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v))::INTEGER - 1 AS c, v FROM v WHERE vec_id IS NOT NULL
  QUALIFY c < {k}),
{", ".join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)
"""


@_query("op13_hadamard_clusters", _centroid_sql(centroids.CENTROIDS, centroids.ROUNDS, centroids.SEED))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))
