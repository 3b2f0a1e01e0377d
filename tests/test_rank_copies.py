"""Gold ranks: vectors are written once as given and once with their block, and
looked at once for the golds; the modes of the validity filter share the ranks."""

from pyspark.sql import functions as F

from ranksmith.operators import dense, dense_index
from ranksmith.plans import eval_queries
from ranksmith.session import staged


def _vectors(spark, n):
    v = F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(8)])
    return spark.range(n).select(F.col("id"), F.lit("a").alias("s"), v.alias("v"))


def test_index_writes_no_second_copy(spark, monkeypatch):
    written = []
    monkeypatch.setattr(dense_index, "staged", lambda df, label: written.append((label, "_vec" in df.columns)) or staged(df, label))
    index = dense_index.cluster_index(_vectors(spark, 300), "id", "v", ["s"], block_rows=16)
    assert [label for label, vectors in written if vectors] == ["vectors", "assigned"]
    rows = index.vectors.select("s", "_id").collect()
    assert sorted(r["_id"] for r in rows) == list(range(300))
    assert sum(r.n.sum() for r in index.rings.value.values()) == 300
    held = {r["_block"]: r["count"] for r in index.vectors.groupBy("_block").count().collect()}
    own = index.rings.value[("a",)]
    assert held == dict(zip(own.block.tolist(), own.n.tolist()))


def test_golds_are_scored_once(spark):
    v = staged(_vectors(spark, 300), "test-vectors")
    index = dense_index.cluster_index(v, "id", "v", ["s"], block_rows=16)
    q = v.filter("id % 20 = 0").select("s", F.col("id").alias("qid"), F.col("v").alias("qvec"))
    gold = F.when(F.col("qid") == 40, 999).when(F.col("qid") == 60, None).otherwise((F.col("qid") + 7) % 300)
    q = q.withColumn("gold", gold).unionByName(q.filter("qid = 0").withColumn("gold", F.lit(5)).withColumn("qid", F.lit(1000)))
    q = q.unionByName(q.limit(1).withColumn("qvec", F.lit(None).cast("array<double>")).withColumn("qid", F.lit(2000)))
    how = dict(gold="gold", pid="id", pvec="v", scope=["s"], other_than_self=True)
    rows = lambda df: sorted((r.qid, r["rank"], r.n_scored) for r in df.collect())
    ranked = dense.gold_rank_full(q, v, index=index, **how)
    assert rows(ranked) == rows(dense.gold_rank_full(q, v, **how))
    assert {(40, 301, 300), (60, 301, 300), (2000, 301, 300)} <= set(rows(ranked))
    # neither the scores nor the golds' vectors are taken from the corpus again for those that are missing
    assert "zip_with" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_validity_modes_share_the_ranks(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def rank(i):
        asked.add(1)
        return i + 1

    ids = spark.range(8).repartition(2)
    monkeypatch.setattr(eval_queries, "vec_gold_ranks", lambda s, d: ids.select(
        F.lit("A").alias("model"), F.col("id").alias("query_id"), rank("id").alias("rank")))
    monkeypatch.setattr(eval_queries.td, "vectors", lambda s, d: ids.select(F.col("id").alias("vec_id"), (F.col("id") % 4).cast("int").alias("label")))
    got = {r["mode"]: (r["MRR@10"], r["Recall@10"], r.n) for r in eval_queries.q_validity_filter_rank(spark, "").collect()}
    kept = [1 / (i + 1) for i in range(8) if i % 4]
    assert got == {"drop": (round(sum(kept) / 6, 6), 1.0, 6), "zero": (round(sum(kept) / 8, 6), 0.75, 8)}
    assert asked.value == 8
