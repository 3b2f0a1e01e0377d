"""Blocked exact top-k and gold ranks against numpy brute force, and the
metric goldens from the reference's committed results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import dense
from ranksmith.operators import evaluate as E


def _frames(spark, Q, P, gold=None):
    q = spark.createDataFrame([(i, [float(x) for x in v], (gold[i] if gold is not None else None))
                               for i, v in enumerate(Q)], "qid long, qvec array<double>, gold_pid long")
    p = spark.createDataFrame([(100 + j, [float(x) for x in v]) for j, v in enumerate(P)], "pid long, pvec array<double>")
    return q, p


def _brute_topk(Q, P, k):
    out = {}
    for i, q in enumerate(Q):
        s = np.round(P @ q, 9)
        order = sorted(range(len(P)), key=lambda j: (-s[j], 100 + j))
        out[i] = [100 + j for j in order[:k]]
    return out


@pytest.mark.parametrize("block_bytes", [3 * 8 * 6, 1 << 20])  # 3 queries per block, or all
def test_dense_topk_matches_brute_force(spark, block_bytes):
    rng = np.random.default_rng(7)
    Q = rng.normal(size=(11, 6))
    P = np.round(rng.normal(size=(40, 6)), 1)
    P[5] = P[6]  # exact ties, broken by id
    t = dense.dense_topk(*_frames(spark, Q, P), k=5, block_bytes=block_bytes)
    got = {}
    for r in t.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.pid)
    assert got == _brute_topk(Q, P, 5)


@pytest.mark.parametrize("block_bytes", [2 * 8 * 5, 1 << 20])  # split scopes / pack scopes
def test_dense_topk_scoped(spark, block_bytes):
    rng = np.random.default_rng(5)
    rows_q, rows_p, want = [], [], {}
    for lang in ("de", "en", "fr"):
        Q = rng.normal(size=(4, 5))
        P = rng.normal(size=(12, 5))
        rows_q += [(lang, f"{lang}{i}", [float(x) for x in v]) for i, v in enumerate(Q)]
        rows_p += [(lang, 100 + j, [float(x) for x in v]) for j, v in enumerate(P)]
        for i, top in _brute_topk(Q, P, 3).items():
            want[(lang, f"{lang}{i}")] = top
    q = spark.createDataFrame(rows_q, "lang string, qid string, qvec array<double>")
    p = spark.createDataFrame(rows_p, "lang string, pid long, pvec array<double>")
    got = {}
    for r in dense.dense_topk(q, p, k=3, scope=["lang"], block_bytes=block_bytes).orderBy("lang", "qid", "rank").collect():
        got.setdefault((r.lang, r.qid), []).append(r.pid)
    assert got == want


def test_corpus_smaller_than_k(spark):
    Q = np.eye(2)
    P = np.array([[1.0, 0.0], [0.0, 1.0]])
    t = dense.dense_topk(*_frames(spark, Q, P), k=10)
    assert t.count() == 4


def test_gold_rank_full(spark):
    rng = np.random.default_rng(3)
    Q = rng.normal(size=(7, 4))
    P = rng.normal(size=(30, 4))
    gold = [100 + g for g in [0, 5, 9, 29, 3, 3, 999]]  # last one is missing from the corpus
    q, p = _frames(spark, Q, P, gold)
    got = {r.qid: r.rank for r in dense.gold_rank_full(q, p, block_bytes=2 * 8 * 4).collect()}
    for i in range(7):
        if gold[i] == 100 + 999:
            assert got[i] == len(P) + 1
            continue
        s = np.round(P @ Q[i], 9)
        g = gold[i] - 100
        want = 1 + sum(1 for j in range(len(P)) if s[j] > s[g] or (s[j] == s[g] and j < g))
        assert got[i] == want


def test_score_all_pairs(spark):
    Q = np.array([[1.0, 0.0], [0.5, 0.5]])
    P = np.array([[1.0, 1.0], [2.0, 0.0], [0.0, 3.0]])
    r = {x.qid: x for x in dense.score_all_pairs(*_frames(spark, Q, P), block_bytes=8).collect()}
    assert r[0].n_scored == 3 and r[0].score_sum == pytest.approx(3.0) and r[0].score_max == pytest.approx(2.0)


def test_embed_batches_skip_and_zero(spark):
    def flaky():
        def enc(texts):
            if any(t == "boom" for t in texts):
                raise RuntimeError("model failed")
            return np.ones((len(texts), 3))
        return enc
    df = spark.createDataFrame([("a",), ("b",), ("boom",)], "t string").coalesce(1)
    assert dense.embed_batches(df, "t", flaky, batch_size=2, on_error="skip").count() == 2
    z = dense.embed_batches(df, "t", flaky, batch_size=2, on_error="zero").collect()
    assert sorted(sum(r.embedding) for r in z) == [0.0, 3.0, 3.0]


# --- goldens: the reference's committed phase-4 numbers -------------------------------------

PHASES = {
    "Phase 2 (BM25)": {"MRR@10": 0.02592989417989418, "nDCG@10": 0.03456402079337528,
                       "Recall@1": 0.013333333333333334, "Recall@5": 0.04, "Recall@10": 0.06333333333333334},
    "Phase 3 (LLM)": {"MRR@10": 0.07127645502645502, "nDCG@10": 0.11286728205510296,
                      "Recall@1": 0.01, "Recall@5": 0.15, "Recall@10": 0.25},
    "Phase 4 (RAG)": {"MRR@10": 0.12365343915343914, "nDCG@10": 0.16623454397629978,
                      "Recall@1": 0.06333333333333334, "Recall@5": 0.2, "Recall@10": 0.30666666666666664},
}
IMPROVEMENTS = {
    ("Phase 2 (BM25)", "Phase 3 (LLM)"): {"MRR@10": 174.88139570473905, "nDCG@10": 226.54557966455013,
                                         "Recall@1": -25.000000000000007, "Recall@5": 274.99999999999994,
                                         "Recall@10": 294.7368421052631, "Average": 189.23276349491044},
    ("Phase 2 (BM25)", "Phase 4 (RAG)"): {"MRR@10": 376.8759883691271, "nDCG@10": 380.9467769101711,
                                         "Recall@1": 375.0, "Recall@5": 400.0, "Recall@10": 384.21052631578937,
                                         "Average": 383.40665831901754},
    ("Phase 3 (LLM)", "Phase 4 (RAG)"): {"MRR@10": 73.48427206087037, "nDCG@10": 47.28319930229415,
                                        "Recall@1": 533.3333333333334, "Recall@5": 33.33333333333335,
                                        "Recall@10": 22.666666666666657, "Average": 142.0201609392996},
}


def _long(spark):
    return spark.createDataFrame([(m, k, v) for m, d in PHASES.items() for k, v in d.items()],
                                 "model string, metric string, value double")


def test_improvement_table_golden(spark):
    t = E.improvement_table(_long(spark), list(IMPROVEMENTS))
    got = {(r.base, r.new, r.metric): r.improvement_pct for r in t.collect()}
    for pair, d in IMPROVEMENTS.items():
        for metric, v in d.items():
            assert got[(*pair, metric)] == pytest.approx(v, rel=1e-12)


def test_model_ranking_golden(spark):
    wide = spark.createDataFrame([(m, *d.values()) for m, d in PHASES.items()],
                                 "model string, `MRR@10` double, `nDCG@10` double, `Recall@1` double, "
                                 "`Recall@5` double, `Recall@10` double")
    r = {x.position: x.model for x in E.model_ranking(wide, E.FULL_METRICS).collect()}
    assert r == {1: "Phase 4 (RAG)", 2: "Phase 3 (LLM)", 3: "Phase 2 (BM25)"}


def test_macro_average_golden(spark):
    per_lang = [("in_distribution", "BM25 Baseline", "swahili", 0.4197, 0.77, 0.504),
                ("in_distribution", "BM25 Baseline", "bengali", 0.6196, 0.94, 0.6977),
                ("in_distribution", "BM25 Baseline", "telugu", 0.2897, 0.52, 0.3443),
                ("zero_shot", "RAG Enhanced", "chinese", 0.4816, 0.8381, 0.5674),
                ("zero_shot", "RAG Enhanced", "french", 0.3477, 0.6762, 0.4258),
                ("zero_shot", "RAG Enhanced", "dutch", 0.3434, 0.6190, 0.4094),
                ("zero_shot", "RAG Enhanced", "german", 0.3301, 0.7048, 0.4180)]
    df = spark.createDataFrame(per_lang, "setting string, model string, lang string, `MRR@10` double, "
                                         "`Recall@10` double, `nDCG@10` double")
    got = {(r.setting, r.model): r for r in E.macro_average(df).collect()}
    a = got[("in_distribution", "BM25 Baseline")]
    assert (a["MRR@10"], a["Recall@10"], a["nDCG@10"]) == pytest.approx((0.4430, 0.7433333, 0.5153333), abs=1e-6)
    z = got[("zero_shot", "RAG Enhanced")]
    assert (z["MRR@10"], z["Recall@10"], z["nDCG@10"]) == pytest.approx((0.3757, 0.709525, 0.45515), abs=1e-6)


def test_metrics_from_ranks(spark):
    ranks = spark.createDataFrame([("m", 1), ("m", 5), ("m", 6), ("m", 10), ("m", 11), ("m", None)],
                                  "model string, rank int")
    full = E.metrics_full(ranks).first()
    assert full["MRR@10"] == pytest.approx((1 + 1 / 5 + 1 / 6 + 1 / 10) / 6)
    assert full["Recall@1"] == pytest.approx(1 / 6) and full["Recall@5"] == pytest.approx(2 / 6)
    assert full["Recall@10"] == pytest.approx(4 / 6)
    assert full["nDCG@10"] == pytest.approx((1 + 1 / np.log2(6) + 1 / np.log2(7) + 1 / np.log2(11)) / 6)
    top = E.metrics_topk(ranks).first()
    assert top["MRR@10"] == round((1 + 1 / 5 + 1 / 6 + 1 / 10) / 6, 4)


def test_metrics_monotone_in_k(spark):
    ranks = spark.createDataFrame([("m", int(r)) for r in np.random.default_rng(1).integers(1, 20, 50)],
                                  "model string, rank int")
    f = E.metrics_full(ranks).first()
    assert f["Recall@1"] <= f["Recall@5"] <= f["Recall@10"]


def test_validity_drop_vs_zero(spark):
    ranks = spark.createDataFrame([("m", 1, True), ("m", 1, False)], "model string, rank int, ok boolean")
    assert E.metrics_full(ranks, valid="ok", on_error="drop").first()["MRR@10"] == 1.0
    assert E.metrics_full(ranks, valid="ok", on_error="zero").first()["MRR@10"] == 0.5


def test_summary_pivot_na(spark):
    macro = spark.createDataFrame([("in_distribution", "a", 0.1, 0.2, 0.3)],
                                  "setting string, model string, `MRR@10` double, `Recall@10` double, `nDCG@10` double")
    r = E.summary_pivot(macro, ["in_distribution", "zero_shot"]).first()
    assert r["in_distribution|MRR@10"] == "0.1000" and r["zero_shot|MRR@10"] == "N/A"
