"""Blocks of a large corpus grow, and what leaves a block is bounded."""

import random

from pyspark.sql import functions as F

from ranksmith.operators import blockmax, bm25


def _texts(n, seed=1):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice("abcdefgh") + (str(rnd.randint(0, 60)) if rnd.random() < 0.5 else "") for _ in range(12)) + f" u{i}"
            for i in range(n)]


def _index(spark, n):
    corpus = spark.createDataFrame([(t,) for t in _texts(n)], "passage string")
    return bm25.bm25_index(corpus), [(f"q{i}", t) for i, t in enumerate([*_texts(6, 2), "a a b", "zzz", "h7 u3"])]


def test_blocks_grow_and_keep_the_best(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK_DOCS", 8)
    index, rows = _index(spark, 400)
    q = spark.createDataFrame(rows, "k string, t string")
    assert blockmax.grown_blocks(index) == 50
    sizes = blockmax.posting_blocks(index, 50).select("block", F.explode("docs.pid").alias("p")).groupBy("block").agg(F.count_distinct("p"))
    assert sizes.count() <= 24
    rank = lambda s: {(r.k, r.pid, r.pid2): round(r.score, 9) for r in s.collect()}
    every = rank(bm25.bm25_scores(index, q, ["k"], "t"))
    got = rank(blockmax.best_scores(index, q, ["k"], "t", 5))
    assert all(every[x] == s for x, s in got.items())
    for k in {x[0] for x in every}:
        top = sorted((s for x, s in every.items() if x[0] == k), reverse=True)[:5]
        want = {x for x, s in every.items() if x[0] == k and s >= top[-1]}
        assert want <= {x for x in got if x[0] == k}


def test_matches_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "DENSE_TERMS", 3)
    index, rows = _index(spark, 300)
    q = spark.createDataFrame(rows, "k string, t string")
    m = bm25.posting_matches(index, q, ["k"], "t").groupBy("k").agg(
        F.count(F.lit(1)).alias("n_postings"), F.count_distinct("pid", "pid2").alias("n_docs"), F.sum(F.col("qtf") * F.col("tf")).alias("tf_mass"))
    seen = lambda df: sorted((r.k, r.n_postings, r.n_docs, r.tf_mass) for r in df.collect())
    got = bm25.posting_counts(index, q, ["k"], "t", block_docs=40)
    assert seen(got) == seen(m) and len(seen(m)) == 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan or "CoGroup" in plan  # matches are no rows


def test_every_score_leaves_its_block_in_pieces(spark, monkeypatch):
    index, rows = _index(spark, 300)
    q = spark.createDataFrame(rows, "k string, t string")
    names = index.corpus.select("pid", "pid2", F.md5("passage").alias("label"))
    want = bm25.bm25_scores(index, q, ["k"], "t").join(names, ["pid", "pid2"])
    got = bm25.bm25_scores(index, q, ["k"], "t", label=F.md5("passage"))
    seen = lambda df: sorted((r.k, r.pid, r.pid2, r.label, round(r.score, 9)) for r in df.collect())
    assert seen(got) == seen(want) and got.columns == ["k", "pid", "pid2", "score", "label"]
    # Scored rows go through no exchange: the Python step is the plan's last.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("FlatMapGroupsInArrow")]
    table = index.corpus.limit(0)
    assert bm25.bm25_scores(bm25.bm25_index(table.select("passage")), q, ["k"], "t", label=F.md5("passage")).collect() == []


def test_postings_move_once_to_their_blocks(spark):
    index, _ = _index(spark, 100)
    plan = index.counts._jdf.queryExecution().executedPlan().toString()
    blocks = blockmax.posting_blocks(index, 16)
    made = blocks._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange hashpartitioning(term") == 0  # terms are counted where the texts are
    assert made.count("Generate explode") == 0  # nothing tokenizes or counts again
    sums = blocks.select(F.sum("tfs").alias("t"), F.sum(F.size("docs")).alias("n")).first()
    assert (sums.t, sums.n) == tuple(index.counts.agg(F.sum("tf"), F.count(F.lit(1))).first())
