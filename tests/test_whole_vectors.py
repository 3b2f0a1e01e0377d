"""Vector searches: every vector is a query and part of the corpus."""

import numpy as np
from pyspark.sql import functions as F

from ranksmith.plans import ORACLE, dense_queries


def test_every_vector_is_a_query(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(1, 24)]  # none is a multiple of 50
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(dense_queries.td, "vectors", lambda s, d: v)
    x = {i: np.array(e) * np.arange(1, 5) ** 0.25 for i, e, _ in rows}
    x = {i: e / np.linalg.norm(e) for i, e in x.items()}
    want = {i: max((j for j in x if j != i), key=lambda j: x[i] @ x[j]) for i in x}
    assert {r.query_id: r.gold_id for r in dense_queries.vec_gold(spark, "").collect()} == want
    got = dense_queries.q_gold_rank_full(spark, "").groupBy("model").agg(F.countDistinct("query_id").alias("n")).collect()
    assert {r.model: r.n for r in got} == {"A": 23, "B": 23, "C": 23}
    for name in ("dense_topk", "gold_rank_full", "metrics_topk", "model_ranking"):
        assert "vec_id %" not in ORACLE[name]
