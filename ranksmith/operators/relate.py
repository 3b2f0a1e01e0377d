"""Joins over query / corpus / relevance (qrels) tables.

Ids are strings throughout (cast at the boundary); null ids never join, so
they are dropped first.  The physical strategy is Catalyst's: AQE turns a
join into a broadcast when a side is measured small, and splits skewed
partitions of sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cast_ids(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ids to string before joining (int and string ids must meet)."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def relevant(qrels: DataFrame, min_score: int | None) -> DataFrame:
    """The judgements of at least ``min_score`` (None: all, as the score is
    ignored unless asked for)."""
    return qrels if min_score is None else qrels.filter(F.col("score") >= min_score)


def join_qrels_inner(qrels: DataFrame, queries: DataFrame, corpus: DataFrame,
                     query_out: str = "query_text", passage_out: str = "gold_passage",
                     keep: Sequence[str] = (), min_score: int | None = None) -> DataFrame:
    """qrels ⋈ queries on query id ⋈ corpus on corpus id (inner), projected
    to (query, passage) and null rows dropped.  One row per qrels row of at
    least ``min_score``."""
    q = cast_ids(queries, ["query_id"]).select("query_id", F.col("text").alias(query_out))
    c = cast_ids(corpus, ["corpus_id"]).select("corpus_id", F.col("text").alias(passage_out))
    r = cast_ids(relevant(qrels, min_score), ["query_id", "corpus_id"]).na.drop(subset=["query_id", "corpus_id"])
    out = r.join(q, "query_id").join(c, "corpus_id")
    return out.select(*keep, query_out, passage_out).na.drop(subset=[query_out, passage_out])


def join_qrels_eval(qrels: DataFrame, queries: DataFrame, corpus: DataFrame,
                    nrows: int | None = None, min_score: int | None = None) -> DataFrame:
    """Evaluation pairs ``(query, passage)`` for the first ``nrows`` queries
    by query id (the source's file order has no Spark meaning)."""
    q = cast_ids(queries, ["query_id"])
    if nrows is not None:
        q = q.orderBy("query_id").limit(nrows)
    return join_qrels_inner(qrels, q, corpus, "query", "passage", keep=["query_id", "corpus_id"], min_score=min_score)


def join_qrels_left(qrels: DataFrame, queries: DataFrame, corpus: DataFrame, min_score: int | None = None) -> DataFrame:
    """qrels ⟕ queries ⟕ corpus, project (query, passage), distinct, drop
    rows with a missing side."""
    q = cast_ids(queries, ["query_id"]).select("query_id", F.col("text").alias("query"))
    c = cast_ids(corpus, ["corpus_id"]).select("corpus_id", F.col("text").alias("passage"))
    r = cast_ids(relevant(qrels, min_score), ["query_id", "corpus_id"])
    out = r.join(q, "query_id", "left").join(c, "corpus_id", "left").select("query", "passage")
    return out.distinct().na.drop()


def qrels_referential_filter(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Keep qrels whose query id and corpus id both exist (semi joins)."""
    r = cast_ids(qrels, ["query_id", "corpus_id"]).na.drop(subset=["query_id", "corpus_id"])
    r = r.join(cast_ids(queries, ["query_id"]).select("query_id"), "query_id", "left_semi")
    return r.join(cast_ids(corpus, ["corpus_id"]).select("corpus_id"), "corpus_id", "left_semi")


def require_no_orphans(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> None:
    """Raise if a qrels row's query or document is missing (one row is read)."""
    r = cast_ids(qrels, ["query_id", "corpus_id"]).select("query_id", "corpus_id")
    sides = [r.join(cast_ids(t, [c]).select(c), c, "left_anti").select("query_id", "corpus_id")
             for t, c in ((queries, "query_id"), (corpus, "corpus_id"))]
    if left := sides[0].unionByName(sides[1]).limit(1).collect():
        raise ValueError(f"qrels row without its query or document: {left[0].query_id!r}, {left[0].corpus_id!r}")


def qrels_orphans(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per side: qrels rows whose id is present / absent in that table."""
    r = cast_ids(qrels, ["query_id", "corpus_id"])
    qf = r.join(cast_ids(queries, ["query_id"]).select("query_id").distinct()
                .withColumn("_q", F.lit(True)), "query_id", "left")
    both = qf.join(cast_ids(corpus, ["corpus_id"]).select("corpus_id").distinct()
                   .withColumn("_c", F.lit(True)), "corpus_id", "left")
    one = both.agg(F.count_if(F.col("_q").isNotNull()).alias("q_present"),
                   F.count_if(F.col("_q").isNull()).alias("q_absent"),
                   F.count_if(F.col("_c").isNotNull()).alias("c_present"),
                   F.count_if(F.col("_c").isNull()).alias("c_absent"))
    return one.selectExpr("stack(2, 'query', q_present, q_absent, 'corpus', c_present, c_absent) "
                          "as (side, present, absent)")


def substring_containment_join(needles: DataFrame, needle: str, docs: DataFrame, text: str,
                               gram: int = 8) -> DataFrame:
    """All (needle row, doc row) with ``contains(doc.text, needle)``, without a
    nested-loop join.

    Candidates come from an equi-join on character-gram keys.  A needle of
    length ``L`` uses grams of ``g = min(gram, L)`` characters, ``m`` grams
    per key (two when the needle is long enough, else one) and a spacing
    ``s``, the largest power of two with ``m*s <= L - g + 1``.  Documents
    expose, at every position that is a multiple of ``s``, the key made of
    the grams at that position and ``s`` further on; a needle probes with the
    keys at its offsets ``0..s-1``.  Any occurrence of the needle contains
    one such document position together with the next one, so every true
    pair is a candidate, and the two-gram key makes false candidates rare.
    Candidates are verified with ``contains``.  The (g, s, m) tiers are a
    handful of values collected from a one-column aggregate.
    """
    nd = needles.withColumn("_L", F.length(needle)).filter(F.col("_L") > 0) \
        .withColumn("_g", F.least(F.col("_L"), F.lit(gram)))
    span = F.col("_L") - F.col("_g") + 1
    nd = nd.withColumn("_m", F.when(span >= 2, F.lit(2)).otherwise(F.lit(1)))
    nd = nd.withColumn("_s", F.pow(F.lit(2), F.floor(F.log2(span / F.col("_m")))).cast("int"))
    tiers = [(r["_g"], r["_s"], r["_m"]) for r in nd.select("_g", "_s", "_m").distinct().collect()]
    nd = nd.withColumn("_nid", F.xxhash64(*[F.col(c) for c in needles.columns]))
    dd = docs.withColumn("_did", F.xxhash64(*[F.col(c) for c in docs.columns])) \
        .withColumn("_dl", F.length(text))

    def key(col, start) -> F.Column:
        return F.substring(col, start + 1, g) if m == 1 else \
            F.concat(F.substring(col, start + 1, g), F.substring(col, start + s + 1, g))

    cands = None
    for g, s, m in tiers:
        # keys are built as arrays and exploded alone, so no row copies the text
        probes = nd.filter((F.col("_g") == g) & (F.col("_s") == s) & (F.col("_m") == m)) \
            .select("_nid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(s - 1)),
                                                  lambda o: key(F.col(needle), o))).alias("_key"))
        reach = g + (m - 1) * s  # characters a key covers
        last = F.floor((F.col("_dl") - reach) / s).cast("int")
        # One linear pass cuts the text into s-character chunks; a key is the
        # first g characters of chunk k (and of chunk k+1).  Substrings of a
        # long UTF-8 text cost O(position), so they are taken on chunks only.
        chunked = dd.filter(F.col("_dl") >= reach).select(
            "_did", "_dl", F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{s}}}"), 0).alias("_ch"))

        span_chunks = -(-g // s)  # chunks a gram reaches into

        def gram_at(k):
            return F.substring(F.array_join(F.slice(F.col("_ch"), k + 1, span_chunks), ""), 1, g)

        def anchor(k):
            return gram_at(k) if m == 1 else F.concat(gram_at(k), gram_at(k + 1))
        anchors = chunked.select("_did", F.explode(F.transform(F.sequence(F.lit(0), last), anchor)).alias("_key"))
        c = probes.join(anchors, "_key").select("_nid", "_did")
        cands = c if cands is None else cands.unionByName(c)
    if cands is None:  # no needles: empty result with the joined schema
        schema = T.StructType(needles.schema.fields + docs.schema.fields)
        return needles.sparkSession.createDataFrame([], schema)
    pairs = cands.distinct()
    out = pairs.join(nd.drop("_L", "_g", "_s", "_m"), "_nid").join(dd.drop("_dl"), "_did")
    return out.filter(F.col(text).contains(F.col(needle))).drop("_nid", "_did")


def score_lookup_join(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(misses, hits): rows without a cached score (anti join) and rows with
    their cached score (inner join)."""
    misses = rows.join(cache.select(key).distinct(), key, "left_anti")
    hits = rows.join(cache, key, "inner")
    return misses, hits


def compare_models(metrics: DataFrame, models: Sequence[str], metric_col: str = "metric",
                   model_col: str = "model", value_col: str = "value") -> DataFrame:
    """One row per metric, one column per model (pivot with a fixed value
    list so no extra job discovers the models)."""
    return metrics.groupBy(metric_col).pivot(model_col, list(models)).agg(F.first(value_col))


def attach_context(triplets: DataFrame, topk: DataFrame, query: str = "query_text",
                   k: int = 3) -> DataFrame:
    """Join each row with the array of its query's top-``k`` passages in rank
    order (``topk``: query, rank, passage); at most ``k`` per query."""
    ctx = topk.filter(F.col("rank") <= k).groupBy(query).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))),
                    lambda x: x["passage"]).alias("contexts"))
    return triplets.join(ctx, query, "left").withColumn(
        "contexts", F.coalesce(F.col("contexts"), F.array().cast("array<string>")))


def first_by_order(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "_rn") -> DataFrame:
    """One row per key: the first by ``order`` (deterministic dedup)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) == 1).drop(out)
