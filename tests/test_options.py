"""Options that depart from the default behaviour, and checks that raise."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ranksmith.functions import text as X
from ranksmith.operators import dense, evaluate, profile, quantiles, relate, select
from ranksmith.session import shared_dir
from ranksmith.sources import files, records


def test_preamble_can_be_dropped(spark):
    df = spark.createDataFrame([("Sure:\nhere\n1. a\nb\n2. c",), ("no numbers",), ("",), ("1. x",)], "t string")
    got = [tuple(r) for r in df.select(X.parse_numbered_list("t", 5), X.parse_numbered_list("t", 5, drop_preamble=True)).collect()]
    assert got == [(["Sure: here", "a b", "c"], ["a b", "c"]), (["no numbers"], ["no numbers"]), ([], []), (["x"], ["x"])]


def test_least_relevance(spark):
    qrels = spark.createDataFrame([("q", "d0", 0), ("q", "d1", 1), ("q", "d2", 2)], "query_id string, corpus_id string, score int")
    q = spark.createDataFrame([("q", "query")], "query_id string, text string")
    c = spark.createDataFrame([(f"d{i}", f"p{i}") for i in range(3)], "corpus_id string, text string")
    found = lambda f, **kw: sorted(r[-1] for r in f(qrels, q, c, **kw).collect())
    for f in (relate.join_qrels_inner, relate.join_qrels_eval, relate.join_qrels_left):
        assert found(f) == ["p0", "p1", "p2"] and found(f, min_score=1) == ["p1", "p2"]


def test_metrics_by_query(spark):
    ranks = spark.createDataFrame([("m", "q1", 1), ("m", "q1", 4), ("m", "q2", None), ("m", "q3", 2), ("m", "q3", None)],
                                  "model string, q string, rank int")
    by_row, by_query = (evaluate.metrics_topk(ranks, ["model"], query=q).first() for q in ((), ("q",)))
    assert (by_row.n, by_query.n) == (5, 3)
    assert by_query["MRR@10"] == pytest.approx((1 + 0.5) / 3, abs=1e-4) and by_row["MRR@10"] == pytest.approx((1 + 0.25 + 0.5) / 5, abs=1e-4)
    assert evaluate.metrics_full(ranks, ["model"], query=("q",)).first()["Recall@1"] == pytest.approx(1 / 3)


def test_cosine_with_epsilon(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "pid long, pvec array<double>")
    q = spark.createDataFrame([(9, [6.0, 8.0])], "qid long, qvec array<double>")
    r = dense.score_all_pairs(q, v, eps=0.5).first()
    assert (r.n_scored, r.score_sum) == (2, pytest.approx(50 / 50.5))


def test_orphans_raise(spark):
    q = spark.createDataFrame([("q",)], "query_id string")
    c = spark.createDataFrame([("d",)], "corpus_id string")
    good, bad = (spark.createDataFrame([(a, b)], "query_id string, corpus_id string") for a, b in (("q", "d"), ("q", "gone")))
    relate.require_no_orphans(good, q, c)
    with pytest.raises(ValueError, match="gone"):
        relate.require_no_orphans(bad, q, c)


def test_absent_qrels_file_has_no_rows(spark, tmp_path):
    assert records.replicate_qrels_file(spark, str(tmp_path / "none.tsv"), ["a", "b"]).count() == 0
    (tmp_path / "some.tsv").write_text("q\td\t1\n")
    got = records.replicate_qrels_file(spark, str(tmp_path / "some.tsv"), ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [("q", "d", 1, "a"), ("q", "d", 1, "b")]


def test_evaluation_cache(spark):
    path, built = shared_dir(spark, "cache-test"), []

    def use(rows, setting="s"):
        source = spark.createDataFrame(rows, "lang string, x int")
        return sorted(r.x for r in files.eval_cache(spark, path, lambda: (built.append(setting), source)[1], ["lang"], setting, source).collect())

    assert use([("a", 1), ("b", 2)]) == [1, 2] and built == ["s"]
    assert use([("b", 2), ("a", 1)]) == [1, 2] and built == ["s"]  # a hit, in any order
    assert use([("a", 5)], "t") == [5] and built == ["s", "t"]  # another setting beside it
    assert use([("a", 1), ("b", 3)]) == [1, 3] and built == ["s", "t", "s"]  # as many rows, other values
    assert use([("a", 5)], "t") == [5] and len(built) == 3
    assert use([("a", 1), ("b", 2)]) == [1, 2] and len(built) == 4  # the stale entry went


@pytest.mark.parametrize("buckets, rows", [(1024, 4096), (4, 3)])
def test_percentiles_by_histograms(spark, buckets, rows):
    values = [(g, v) for g, n in (("a", 500), ("b", 7), (None, 60), ("c", 1)) for v in [((i * 7919) % 1009) / 7 for i in range(n)]]
    values += [("d", 2.5)] * 40 + [("d", 9.0)] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(values, "g string, v double")
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.value for r in quantiles.exact_percentiles(df, ["g"], "v", ps, buckets, rows).collect()}
    clean = df.filter("v is not null and not isnan(v)")
    want = {(r.g, p): r.x[i] for r in clean.groupBy("g").agg(F.percentile("v", ps).alias("x")).collect() for i, p in enumerate(ps)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_threshold_and_ratios(spark):
    df = spark.createDataFrame([(i / 10,) for i in range(11)], "rag_score double")
    assert select.quantile_threshold(df, p=0.3) == pytest.approx(0.7) and select.quantile_threshold(df.limit(0)) is None
    t = spark.createDataFrame([(None, "ab", "abcd", "a"), ("x", "a", "", "abc"), ("x", "abc", "ab", None)],
                              "lang string, query_text string, gold_passage string, hard_negative string")
    got = {r.lang: r for r in profile.length_ratio_profile(t).collect()}
    assert got[None].qg_median == 0.5 and got["x"].qg_mean == 1.5 and got["x"].gn_median == 0.0
