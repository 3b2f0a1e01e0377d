"""Dense scans: passages pass by the queries; what is written and moved."""

import numpy as np
from pyspark.sql import functions as F

from ranksmith.operators import dense, dense_index
from ranksmith.plans import dense_queries
from ranksmith.session import staged


def test_texts_are_encoded_where_they_are(spark, monkeypatch):
    rows = [("de", "eins zwei\nmehr Text"), ("de", "eins zwei\nmehr Text"), ("de", "drei"), (None, "four five"), ("en", None), ("en", "")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    monkeypatch.setattr(dense_queries.td, "table", lambda *a: docs)
    written = []
    monkeypatch.setattr(dense, "split_pass", lambda made, path=None, f=dense.split_pass: written.append(set(made.columns)) or f(made, path))
    units, q, p = dense_queries.text_models(spark, "")
    assert len(written) == 4 and not any({"query", "passage"} & w for w in written)
    assert units.count() == 6
    want = {("in_distribution", "de"): 2, ("unlisted", "und"): 1, ("zero_shot", "en"): 1}
    got = {(r.setting, r.lang): r.n for r in p.filter("model = 'bow64'").groupBy("setting", "lang").agg(F.count("pid").alias("n")).collect()}
    assert got == want
    for df, texts, dim in ((p, "passage", 64), (q, "query", 32)):
        enc = dense.hashed_bow_encoder(dim)()
        le = dense_queries.td.lang_eval(spark, "").select(texts).na.drop().distinct().withColumn("id", F.md5(texts)).collect()
        text = {r.id: r[texts] for r in le}
        for r in df.filter(F.col("model") == f"bow{dim}").na.drop().collect():
            assert r[-1] == enc([text[r[-2]]])[0].tolist()


def _spread(spark, n):
    """Many scores that single precision does not tell apart."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(n // 8, 6))
    x = np.repeat(base, 8, axis=0) + rng.normal(size=(n, 6)) * 1e-8
    x[3] = 0.0
    return x, staged(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "test-vectors")


def test_close_scores_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(dense, "HELD_ROWS", 16)
    for scale in (1.0, 1e20):
        x, v = _spread(spark, 320)
        x, v = x * scale, v.withColumn("v", F.transform("v", lambda e: e * scale))
        q = v.filter("id % 10 = 3").select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
        S = x @ x.T
        top = {}
        for r in dense.dense_topk(q, v, k=4, pid="id", pvec="v", block_bytes=6 * 8 * 5, other_than_self=True).collect():
            top.setdefault(r.qid, {})[r["rank"]] = r.id
        golds = q.withColumn("gold", (F.col("qid") + 1) % 320)
        ranks = {r.qid: r["rank"] for r in dense.gold_rank_full(golds, v, gold="gold", pid="id", pvec="v", block_bytes=6 * 8 * 5, other_than_self=True).collect()}
        for i in top:
            s = np.round(S[i], 9) if scale == 1.0 else S[i]
            order = sorted((j for j in range(320) if j != i), key=lambda j: (-s[j], j))
            assert np.allclose([S[i][top[i][r]] for r in range(1, 5)], [S[i][j] for j in order[:4]], rtol=1e-12)
            if scale == 1.0:
                assert [top[i][r] for r in range(1, 5)] == order[:4]
                assert ranks[i] == 1 + order.index((i + 1) % 320)


def test_visits_are_not_rows(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(dense_index, "staged", lambda df, label: labels.append(label) or staged(df, label))
    x, v = _spread(spark, 320)
    index = dense_index.cluster_index(v, "id", "v", block_rows=8)
    q = v.select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
    how = dict(pid="id", pvec="v", other_than_self=True)
    rows = lambda df: sorted((r.qid, r["rank"], r.id) for r in df.collect())
    assert rows(dense.dense_topk(q, v, k=3, index=index, block_bytes=6 * 8 * 40, **how)) == rows(dense.dense_topk(q, v, k=3, **how))
    golds = q.withColumn("gold", (F.col("qid") + 9) % 320)
    ranks = lambda df: sorted((r.qid, r["rank"]) for r in df.collect())
    assert ranks(dense.gold_rank_full(golds, v, gold="gold", index=index, block_bytes=6 * 8 * 40, **how)) == ranks(
        dense.gold_rank_full(golds, v, gold="gold", **how))
    assert not {"other-visits", "rank-visits"} & set(labels)
