"""Lexical retrieval (Okapi BM25) and hard-negative mining as joins.

The index is two DataFrames -- postings ``(term, doc, weight)`` and the
corpus ``(doc, passage)`` -- and scoring is an equi-join of query terms with
postings followed by a ``groupBy(query, doc).sum``.  Only documents sharing a
term with the query are ever touched, instead of scoring the whole corpus for
every query.

Skew: very frequent terms have posting lists that would land in one task.
Terms whose document frequency reaches ``hot_df`` are salted: their postings
are spread over ``salt_buckets`` buckets by document and the query side is
replicated into every bucket, so the join stays balanced.  Per-(doc, term)
and per-term counts use partial (map-side) aggregation before any shuffle.

Documents are identified by text; inside the plan they travel as a pair of
64-bit hashes ``(pid, pid2)`` (128 bits) so shuffles never carry long text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import staged
from .blockmax import best_scores, every_score, match_counts

# Okapi BM25 parameters (k1, b) and the floor factor applied to
# negative idf (a fraction of the mean idf), as in the common Python library.
K1 = 1.5
B = 0.75
EPSILON = 0.25

SCORE_ROUND = 9  # scores are rounded before ranking so ties are stable


def passage_key(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text: a 128-bit shuffle key."""
    return F.xxhash64(text), F.xxhash64(F.lit("ranksmith#"), text)


def build_corpus(df: DataFrame, cols: Sequence[str] = ("gold_passage", "hard_negative"),
                 scope: Sequence[str] = (), out: str = "passage",
                 array_cols: Sequence[str] = ("negatives",)) -> DataFrame:
    """Distinct non-null texts of ``cols`` (gold passages and negatives) and
    of the elements of array columns ``array_cols`` (negatives lists)."""
    parts = [F.array(*[F.col(c) for c in cols if c in df.columns])]
    parts += [F.col(c) for c in array_cols if c in df.columns]
    texts = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.select(*scope, F.explode(texts).alias(out)).na.drop(subset=[out]).distinct()


def _partitions(df: DataFrame) -> int:
    """The session's shuffle partition count (sized by the cluster)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class BM25Index:
    corpus: DataFrame     # scope..., pid, pid2, passage
    doc_stats: DataFrame  # scope..., pid, pid2, dl
    stats: DataFrame      # scope..., n_docs, avgdl, avg_idf  (one row per scope)
    terms: DataFrame      # scope..., term, df, idf, hot
    postings: DataFrame   # scope..., term, pid, pid2, tf, weight, hot
    scope: tuple[str, ...]
    counts: DataFrame     # scope..., pid, pid2, dl, term, tf, partitioned by document
    weigh: Callable[[DataFrame], DataFrame]  # rows of counts -> the same with idf, weight and hot


def bm25_index(corpus: DataFrame, text: str = "passage", scope: Sequence[str] = (),
               k1: float = K1, b: float = B, epsilon: float = EPSILON,
               tokenizer: Callable[[Column], Column] = tokenize,
               hot_df: int = 200_000) -> BM25Index:
    """Index a corpus of distinct texts (one row per text and scope).

    Corpus statistics (document count, mean length, mean idf) are one row
    per scope.  Without a scope they are read back as scalars (one-row
    aggregates) and enter the plan as literals; with a scope they are joined
    on the scope columns as a broadcast of one row per scope value.
    """
    sc = list(scope)
    pid, pid2 = passage_key(F.col(text))
    # The corpus and its (doc, term) counts feed the statistics, the postings
    # and the final text lookup: computed once, kept (spilling to disk).  Dealt
    # by document, so that a document's terms are counted where its text is.
    docs = corpus.select(*sc, pid.alias("pid"), pid2.alias("pid2"), F.col(text).alias("passage")) \
        .repartition(_partitions(corpus), *sc, "pid", "pid2").persist(StorageLevel.MEMORY_AND_DISK)
    toks = docs.select(*sc, "pid", "pid2", tokenizer(F.col("passage")).alias("tokens"))
    doc_stats = toks.select(*sc, "pid", "pid2", F.size("tokens").cast("long").alias("dl"))
    postings0 = toks.select(*sc, "pid", "pid2", F.size("tokens").alias("dl"),
                            F.explode("tokens").alias("term")) \
        .groupBy(*sc, "pid", "pid2", "dl", "term").agg(F.count(F.lit(1)).alias("tf")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    base = doc_stats.groupBy(*sc).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    dfs = postings0.groupBy(*sc, "term").agg(F.count(F.lit(1)).alias("df")).persist(StorageLevel.MEMORY_AND_DISK)
    idf_raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    if sc:
        raw = dfs.join(F.broadcast(base.select(*sc, "n_docs")), sc).withColumn("idf_raw", idf_raw)
        mean_idf = raw.groupBy(*sc).agg(F.avg("idf_raw").alias("avg_idf"))
        stats = base.join(mean_idf, sc)
        raw = raw.join(F.broadcast(mean_idf), sc)
        with_length = lambda rows: rows.join(F.broadcast(base.select(*sc, "avgdl")), sc)
    else:
        one = base.first()
        raw = dfs.withColumn("n_docs", F.lit(one["n_docs"])).withColumn("idf_raw", idf_raw)
        avg_idf = raw.agg(F.avg("idf_raw")).first()[0]
        raw = raw.withColumn("avg_idf", F.lit(avg_idf).cast("double"))
        stats = base.withColumn("avg_idf", F.lit(avg_idf).cast("double"))
        with_length = lambda rows: rows.withColumn("avgdl", F.lit(one["avgdl"]).cast("double"))
    terms = raw.select(*sc, "term", "df",
                       F.when(F.col("idf_raw") < 0, F.lit(epsilon) * F.col("avg_idf"))
                        .otherwise(F.col("idf_raw")).alias("idf"),
                       (F.col("df") >= hot_df).alias("hot"))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    weight = F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)
    weigh = lambda rows: with_length(rows).join(terms, [*sc, "term"]).withColumn("weight", weight)
    # Postings end hash-partitioned by document: a broadcast query side then
    # scores each document's terms inside one task (see posting_matches).
    postings = weigh(postings0).select(*sc, "term", "pid", "pid2", "tf", "weight", "hot") \
        .repartition(_partitions(corpus), "pid", "pid2")
    return BM25Index(docs, doc_stats, stats, terms, postings, tuple(sc), postings0, weigh)


# Query-term rows up to which the query side is broadcast (about 64 bytes a
# row); beyond it the salted shuffle join is used.
BROADCAST_QUERY_TERMS = 1_000_000


def query_terms(index: BM25Index, queries: DataFrame, qkeys: Sequence[str], text: str,
                tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """``(scope..., qkeys..., term, qtf)``: each query's terms with counts."""
    sk = list(index.scope)
    return queries.select(*sk, *qkeys, F.explode(tokenizer(F.col(text))).alias("term")) \
        .groupBy(*sk, *qkeys, "term").agg(F.count(F.lit(1)).alias("qtf"))


def join_postings(index: BM25Index, qt: DataFrame, salt_buckets: int = 16,
                  broadcast_rows: int | None = BROADCAST_QUERY_TERMS) -> DataFrame:
    """Query terms ``qt`` ⋈ postings on (scope, term).

    Two strategies, chosen by a size check on the query side:

    * ``qt`` has at most ``broadcast_rows`` rows: broadcast it.  The postings
      are not shuffled and stay partitioned by document, so the
      (query, document) sum that follows needs no exchange either.
    * larger: shuffle join on (term, salt); terms with ``df >= hot_df`` are
      spread over ``salt_buckets`` buckets by document, the query side is
      replicated into each bucket.
    """
    sk = list(index.scope)
    if sk:  # a long scope id rides along, so later aggregates group on longs only
        qt = qt.withColumn("_sid", F.xxhash64(*[F.col(c) for c in sk]))
    if broadcast_rows is not None:
        qt = qt.persist(StorageLevel.MEMORY_AND_DISK)  # counted now, broadcast below
        if qt.count() <= broadcast_rows:
            return F.broadcast(qt).join(index.postings.drop("hot"), [*sk, "term"])
    hot = index.terms.filter("hot").select(*sk, "term", F.lit(True).alias("_hot"))
    qt = qt.join(hot, [*sk, "term"], "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt_buckets - 1)))
                           .otherwise(F.array(F.lit(0))))).drop("_hot")
    post = index.postings.withColumn(
        "_salt", F.when(F.col("hot"), F.pmod(F.col("pid"), F.lit(salt_buckets))).otherwise(F.lit(0)))
    return qt.join(post, [*sk, "term", "_salt"]).drop("_salt", "hot")


def posting_matches(index: BM25Index, queries: DataFrame, qkeys: Sequence[str], text: str,
                    tokenizer: Callable[[Column], Column] = tokenize,
                    salt_buckets: int = 16, broadcast_rows: int | None = BROADCAST_QUERY_TERMS) -> DataFrame:
    """The posting join: one row per (query, term, document) with the query
    term count ``qtf`` and the posting ``weight`` (see ``join_postings``)."""
    qt = query_terms(index, queries, qkeys, text, tokenizer)
    return join_postings(index, qt, salt_buckets, broadcast_rows)


def posting_counts(index: BM25Index, queries: DataFrame, qkeys: Sequence[str], text: str, **kw) -> DataFrame:
    """``posting_matches`` counted per query, without a row a match:
    ``(qkeys..., n_postings, n_docs, tf_mass)`` (``blockmax.match_counts``)."""
    q, keys, hashed = _keyed(queries, qkeys)
    c = match_counts(index, q, keys, text, **kw)
    return _unkey(c, q, list(index.scope), qkeys) if hashed else c


_NUMERIC = ("int", "bigint", "smallint", "tinyint")


def _keyed(queries: DataFrame, qkeys: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """Text query keys travel through joins and aggregates as a 128-bit hash
    pair; numeric keys are used as they are."""
    types = dict(queries.dtypes)
    if all(types[c] in _NUMERIC for c in qkeys):
        return queries, list(qkeys), False
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001null")) for c in qkeys]
    k1, k2 = passage_key(F.concat_ws("\u0000", *parts))
    return queries.withColumn("_qh", k1).withColumn("_qh2", k2), ["_qh", "_qh2"], True


def _unkey(out: DataFrame, queries: DataFrame, sk: Sequence[str], qkeys: Sequence[str]) -> DataFrame:
    names = queries.select(*sk, "_qh", "_qh2", *qkeys).distinct()
    return out.join(names, [*sk, "_qh", "_qh2"]).drop("_qh", "_qh2")


def bm25_scores(index: BM25Index, queries: DataFrame, qkeys: Sequence[str], text: str,
                tokenizer: Callable[[Column], Column] = tokenize,
                salt_buckets: int = 16, broadcast_rows: int | None = BROADCAST_QUERY_TERMS,
                label: Column | None = None) -> DataFrame:
    """``(scope..., qkeys..., pid, pid2, score)`` for every document sharing
    at least one term with the query.  A repeated query term counts once per
    repetition.  With ``label``, an expression of ``passage``, each row has a
    further column ``label``, and the rows are made in blocks
    (``blockmax.every_score``): as many as they are, none is shuffled."""
    sk = list(index.scope)
    if label is not None:
        return every_score(index, queries, qkeys, text, label, tokenizer)
    q, keys, hashed = _keyed(queries, qkeys)
    # Grouped on longs only -- (scope id, query key, doc key) -- and, with the
    # postings partitioned by document, without an exchange.
    sid = ["_sid"] if sk else []
    s = posting_matches(index, q, keys, text, tokenizer, salt_buckets, broadcast_rows) \
        .groupBy(*sid, *keys, "pid", "pid2") \
        .agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))
    if sk:  # one row per scope value
        names = q.select(*sk).distinct().withColumn("_sid", F.xxhash64(*[F.col(c) for c in sk]))
        s = s.join(F.broadcast(names), "_sid").drop("_sid")
    return _unkey(s, q, sk, qkeys) if hashed else s


PRUNE_SLACK = 1e-8  # far above the 1e-9 rounding used for ties and float noise


def candidates_pruned(index: BM25Index, queries: DataFrame, qkeys: Sequence[str], text: str, n: int,
                      exclude: tuple[str, str] | None = None, rare_df: int | None = None,
                      tokenizer: Callable[[Column], Column] = tokenize,
                      broadcast_rows: int | None = BROADCAST_QUERY_TERMS) -> DataFrame:
    """Exact scores ``(scope..., qkeys..., pid, pid2, score)`` for a set of
    documents per query that is guaranteed to hold its top ``n`` (ties
    included), without joining the postings of frequent terms for every
    matching document.

    Bound-based pruning (max-score style): a query's terms split into rare
    (``df <= rare_df``) and frequent ones.  A document's score is its
    rare-term part plus at most ``ub`` = sum of ``qtf * max weight`` over the
    frequent terms.  With ``theta`` = the n-th best rare-term part, documents
    sharing no rare term (score ``<= ub``) and candidates whose part plus
    ``ub`` stays below ``theta`` cannot enter the top ``n`` when
    ``ub < theta``; the survivors get their frequent-term part by a lookup
    join on (term, document).  Queries where the bound does not separate
    (``ub >= theta``, or fewer than ``n`` candidates) take the full join.
    ``exclude`` names two query columns holding a document key never to
    return (the gold passage).
    """
    sk = list(index.scope)
    keys = [*sk, *qkeys]
    qcols = [*keys, *(exclude or ())]
    qs = queries.select(*qcols).persist(StorageLevel.MEMORY_AND_DISK)

    def drop_excluded(scores: DataFrame) -> DataFrame:
        if not exclude:
            return scores
        g1, g2 = exclude
        return scores.join(qs.select(*keys, *exclude), keys) \
            .filter((F.col("pid") != F.col(g1)) | (F.col("pid2") != F.col(g2))).drop(g1, g2)

    def full(qsel: DataFrame) -> DataFrame:
        part = queries.join(qsel, keys, "left_semi")
        return drop_excluded(bm25_scores(index, part, qkeys, text, tokenizer, broadcast_rows=broadcast_rows))

    neg = index.stats.agg(F.min("avg_idf")).first()[0]
    if neg is not None and neg < 0:  # negative weights: bounds do not hold
        return full(qs.select(*keys))
    if rare_df is None:
        n_docs = index.stats.agg(F.max("n_docs")).first()[0] or 0
        rare_df = max(16, n_docs // 50)
    maxw = index.postings.groupBy(*sk, "term").agg(F.max("weight").alias("maxw"))
    qt = query_terms(index, queries, qkeys, text, tokenizer) \
        .join(index.terms.select(*sk, "term", "df"), [*sk, "term"]) \
        .join(maxw, [*sk, "term"]).persist(StorageLevel.MEMORY_AND_DISK)
    rare = qt.filter(F.col("df") <= rare_df).select(*keys, "term", "qtf")
    freq = qt.filter(F.col("df") > rare_df)
    ub = freq.groupBy(*keys).agg(F.sum(F.col("qtf") * F.col("maxw")).alias("_ub"))
    part_r = drop_excluded(join_postings(index, rare, broadcast_rows=broadcast_rows)
                           .groupBy(*keys, "pid", "pid2")
                           .agg(F.sum(F.col("qtf") * F.col("weight")).alias("_sr")))
    theta = part_r.withColumn("_i", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col("_sr").desc()))).filter(F.col("_i") == n) \
        .select(*keys, F.col("_sr").alias("_theta"))
    info = qs.select(*keys).join(ub, keys, "left").join(theta, keys, "left") \
        .withColumn("_ub", F.coalesce(F.col("_ub"), F.lit(0.0))) \
        .withColumn("_ok", F.col("_theta").isNotNull() & (F.col("_ub") + PRUNE_SLACK < F.col("_theta"))) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    ok = info.filter("_ok").select(*keys, "_ub", "_theta")
    surv = part_r.join(ok, keys).filter(F.col("_sr") + F.col("_ub") + PRUNE_SLACK >= F.col("_theta")) \
        .select(*keys, "pid", "pid2", "_sr")
    look = surv.select(*keys, "pid", "pid2").join(freq.select(*keys, "term", "qtf"), keys)
    post = index.postings.select(*sk, "term", "pid", "pid2", "weight")
    look = look.persist(StorageLevel.MEMORY_AND_DISK)
    if broadcast_rows is not None and look.count() <= broadcast_rows:
        look = F.broadcast(look)
    part_f = look.join(post, [*sk, "term", "pid", "pid2"]) \
        .groupBy(*keys, "pid", "pid2").agg(F.sum(F.col("qtf") * F.col("weight")).alias("_sf"))
    exact = surv.join(part_f, [*keys, "pid", "pid2"], "left") \
        .select(*keys, "pid", "pid2", (F.col("_sr") + F.coalesce(F.col("_sf"), F.lit(0.0))).alias("score"))
    return exact.unionByName(full(info.filter(~F.col("_ok")).select(*keys)))


def _places(scores: DataFrame, index: BM25Index, group: Sequence[str], limit: int) -> DataFrame:
    """Top ``limit`` per group by (rounded score desc, passage asc), without
    the passages.

    A ``rank() <= limit`` pass (kept ties, planned as WindowGroupLimit) trims
    the candidates, which are written.  Only passages that tie with another
    are joined in, to tell their order.
    """
    same = [*group, "_r"]
    trimmed = scores.withColumn("_r", F.round(F.col("score"), SCORE_ROUND)).withColumn(
        "_rk", F.rank().over(Window.partitionBy(*group).orderBy(F.col("_r").desc()))).filter(F.col("_rk") <= limit)
    rows = staged(trimmed.withColumn("_tied", F.count(F.lit(1)).over(Window.partitionBy(*same)) > 1), "ranked-scores")
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("passage").asc()))
    ties = rows.filter("_tied").join(index.corpus, [*index.scope, "pid", "pid2"]).withColumn("_nth", nth).drop("passage")
    placed = rows.filter(~F.col("_tied")).withColumn("_nth", F.lit(1)).unionByName(ties)
    return placed.withColumn("rank", F.col("_rk") + F.col("_nth") - 1).filter(F.col("rank") <= limit) \
        .drop("_r", "_rk", "_tied", "_nth")


def _with_passage(ranked: DataFrame, index: BM25Index, label: Column | None = None) -> DataFrame:
    """``ranked`` with its passages, or with ``label``, an expression of them."""
    own = [*index.scope, "pid", "pid2"]
    text = F.col("passage") if label is None else label.alias("label")
    return ranked.join(index.corpus.select(*own, text), own)


def _ranked(scores: DataFrame, index: BM25Index, group: Sequence[str], limit: int) -> DataFrame:
    """Top ``limit`` per group by (rounded score desc, passage asc)."""
    return _with_passage(_places(scores, index, group, limit), index)


def bm25_topk(index: BM25Index, queries: DataFrame, qkeys: Sequence[str], text: str,
              k: int = 100, label: Column | None = None, **kw) -> DataFrame:
    """Best ``k`` documents per query: ``(qkeys..., rank, passage, score)``,
    from block-max postings (``blockmax.best_scores``, which takes ``kw``).
    With ``label``, an expression of ``passage``, a column ``label`` takes the
    passage's place, and no passage travels with its ranks."""
    sk = list(index.scope)
    q, keys, hashed = _keyed(queries, qkeys)
    s = best_scores(index, q, keys, text, k, **kw)
    top = _with_passage(_places(s, index, [*sk, *keys], k), index, label)
    return _unkey(top, q, sk, qkeys) if hashed else top


def mine_negatives(df: DataFrame, query: str = "query_text", gold: str = "gold_passage",
                   n: int = 1, corpus: DataFrame | None = None,
                   scope: Sequence[str] = (), index: BM25Index | None = None,
                   pad_seed_rows: int | None = None, prune: bool = False, **kw) -> DataFrame:
    """Per distinct (scope, query, gold): ``mined`` = array of up to ``n``
    BM25 negatives (best first, gold excluded).

    The reference ranks the whole corpus, so a query matching fewer than
    ``n`` documents is topped up with zero-score documents; here those pads
    are the smallest texts by ``(md5(text), text)`` that are neither gold nor
    already chosen.  An empty result means the corpus holds nothing but gold.
    """
    sc = list(scope)
    if index is None:
        corpus = corpus if corpus is not None else build_corpus(df, scope=sc)
        if sc:  # a null-safe key of the scope columns goes through every join
            df, corpus = (x.withColumn(SCOPE_KEY, scope_key(sc)) for x in (df, corpus))
        index = bm25_index(corpus, scope=[SCOPE_KEY] if sc else ())
    sk = list(index.scope)
    gp, gp2 = passage_key(F.col(gold))
    qh, qh2 = pair_key(query, gold)
    qs = df.select(*sc, *(c for c in sk if c not in sc), query, gold).distinct() \
        .withColumn("qh", qh).withColumn("qh2", qh2) \
        .withColumn("gpid", gp).withColumn("gpid2", gp2)
    if prune:
        s = candidates_pruned(index, qs, ["qh", "qh2"], query, n, exclude=("gpid", "gpid2"), **kw)
    else:
        s = best_scores(index, qs, ["qh", "qh2"], query, n + 1, **kw)
    if prune:
        top = _places(s, index, [*sk, "qh", "qh2"], n)
    else:
        # The gold fills one place at most: the best n + 1 hold the best n others.
        own = [*sk, "qh", "qh2"]
        best = _places(s, index, own, n + 1).join(qs.select(*own, "gpid", "gpid2"), own)
        best = best.withColumn("_gold", F.col("pid").eqNullSafe(F.col("gpid")) & F.col("pid2").eqNullSafe(F.col("gpid2")))
        best = best.withColumn("_golds", F.max(F.col("_gold").cast("int")).over(Window.partitionBy(*own)))
        top = best.filter(~F.col("_gold") & (F.col("rank") <= n + F.col("_golds")))
    top = _with_passage(top, index)
    chosen = top.groupBy(*sk, "qh", "qh2").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))),
                    lambda x: x["passage"]).alias("_chosen"))
    chosen = chosen.withColumn("_chosen", F.slice("_chosen", 1, n))
    out = qs.join(chosen, [*sk, "qh", "qh2"], "left") \
        .withColumn("_chosen", F.coalesce(F.col("_chosen"), F.array().cast("array<string>")))
    # Pads: the 2n+1 smallest corpus texts by (md5, text) per scope -- at most
    # n are chosen and one is gold, so enough remain.  Bounded: 2n+1 per scope.
    m = pad_seed_rows or 2 * n + 1
    if sk:
        pw = Window.partitionBy(*sk).orderBy(F.md5("passage"), F.col("passage"))
        pads = index.corpus.withColumn("_p", F.row_number().over(pw)).filter(F.col("_p") <= m) \
            .groupBy(*sk).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "passage"))),
                                          lambda x: x["passage"]).alias("_pads"))
        out = out.join(F.broadcast(pads), sk, "left")
    else:
        seeds = [r["passage"] for r in index.corpus.orderBy(F.md5("passage"), "passage").limit(m).collect()]
        out = out.withColumn("_pads", F.array(*[F.lit(t) for t in seeds]).cast("array<string>"))
    g = F.col(gold)
    extra = F.filter(F.coalesce(F.col("_pads"), F.array().cast("array<string>")),
                     lambda p: (p != g) & ~F.array_contains(F.col("_chosen"), p))
    mined = F.slice(F.concat(F.col("_chosen"), extra), 1, n)
    return out.select(*sc, query, gold, "qh", "qh2", mined.alias("mined"))


#: Column of the scope's key inside ``mine_negatives``.
SCOPE_KEY = "_scope_key"


def scope_key(scope: Sequence[str]) -> Column:
    """One long for the values of the scope columns; nulls are values too."""
    return F.xxhash64(*[x for c in scope for x in (F.col(c).isNull(), F.col(c))])


def pair_key(query: str, gold: str) -> tuple[Column, Column]:
    """Key of a (query, gold) pair that tells nulls apart from each other's
    place and from texts."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return passage_key(F.concat_ws("\u0000", mark(query), mark(gold)))


def bm25_hard_negatives(df: DataFrame, query: str = "query_text", gold: str = "gold_passage",
                        n: int = 1, mode: str = "fill", negative: str = "hard_negative",
                        **kw) -> DataFrame:
    """Attach mined negatives to every row of ``df``.

    ``mode``: ``fill`` sets ``negative`` to the first mined text (rows lacking
    the column get it); ``replace`` keeps an existing negative unless the
    mined text is not a substring of it (the reference rule); ``append``
    adds the mined texts to an array column ``negatives`` when not present.
    """
    sc = list(kw.get("scope", ()))
    df = df.persist(StorageLevel.MEMORY_AND_DISK)  # read for the corpus, the queries and the result
    key = scope_key(sc) if sc else F.lit(0).cast("long")
    mined = mine_negatives(df, query, gold, n=n, **kw).select(key.alias(SCOPE_KEY), "qh", "qh2", "mined")
    qh, qh2 = pair_key(query, gold)
    out = df.withColumn("qh", qh).withColumn("qh2", qh2).withColumn(SCOPE_KEY, key) \
        .join(mined, [SCOPE_KEY, "qh", "qh2"], "left").drop(SCOPE_KEY, "qh", "qh2")
    first = F.try_element_at(F.col("mined"), F.lit(1))
    if mode == "fill" or negative not in df.columns:
        out = out.withColumn(negative, first) if mode != "append" else out
    elif mode == "replace":
        neg = F.col(negative)
        out = out.withColumn(negative, F.when(neg.isNull() | ~neg.contains(first), first)
                             .otherwise(neg))
    if mode == "append":
        base = F.coalesce(F.col("negatives"), F.array().cast("array<string>")) \
            if "negatives" in df.columns else F.array().cast("array<string>")
        out = out.withColumn("negatives", F.aggregate(
            F.coalesce(F.col("mined"), F.array().cast("array<string>")), base,
            lambda acc, x: F.when(F.array_contains(acc, x), acc).otherwise(F.concat(acc, F.array(x)))))
    return out.drop("mined")


def explode_triplets(df: DataFrame, negatives: str = "negatives",
                     out: str = "hard_negative") -> DataFrame:
    """One triplet per element of the negatives array (rows with an empty
    array disappear, as in the reference)."""
    return df.select(*[c for c in df.columns if c != negatives], F.explode(negatives).alias(out))


def triplets_to_examples(df: DataFrame, negative: str = "hard_negative") -> DataFrame:
    """Triplet -> example with a one-element (or empty) negatives array."""
    neg = F.col(negative)
    return df.withColumn("negatives", F.when(neg.isNotNull(), F.array(neg))
                         .otherwise(F.array().cast("array<string>"))).drop(negative)
