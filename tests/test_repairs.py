"""Cases that once gave wrong or incomplete results."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import bm25, clean, dense, grade, ordering, profile
from ranksmith.sources import files


def test_qrels_of_mixed_shapes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("q1\tc1\nq2\t0\tc2\t2\nq3\tc3\t0\n\nq4\tc4\tmany\nq5\n")
    (tmp_path / "b.tsv").write_text("q6\tc6\t1\n")
    got = files.normalize_qrels(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("q1", "c1", 1), ("q2", "c2", 2), ("q3", "c3", 0), ("q6", "c6", 1)]
    bad = {r.reason: r.n for r in files.rejected_qrels(spark, str(tmp_path)).collect()}
    assert bad == {"score is no integer": 1, "1 fields": 1}
    (tmp_path / "head").mkdir()
    (tmp_path / "head" / "h.tsv").write_text("query-id\tcorpus-id\tscore\nq1\tc1\t3\n")
    assert [tuple(r) for r in files.normalize_qrels(spark, str(tmp_path / "head"), header=True).collect()] == [("q1", "c1", 3)]


def test_mining_with_null_keys(spark):
    rows = [(None, "alpha beta"), ("alpha beta", None), ("gamma", "gamma delta"), ("gamma", "alpha gamma")]
    df = spark.createDataFrame(rows, "query_text string, gold_passage string")
    got = bm25.bm25_hard_negatives(df).collect()
    assert sorted((r.query_text or "", r.gold_passage or "") for r in got) == sorted((a or "", b or "") for a, b in rows)
    assert all(r.hard_negative != r.gold_passage for r in got)
    by = {(r.query_text, r.gold_passage): r.hard_negative for r in got}
    assert by["gamma", "gamma delta"] == "alpha gamma"


def test_trimmed_mining_is_exact(spark):
    rng = random.Random(3)
    words = list("abcdefgh")
    rows = [(" ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=6))) for _ in range(40)]
    df = spark.createDataFrame(rows, "query_text string, gold_passage string")
    for n in (1, 3):
        plain = {(r.query_text, r.gold_passage): r.mined for r in bm25.mine_negatives(df, "query_text", "gold_passage", n=n).collect()}
        pruned = {(r.query_text, r.gold_passage): r.mined for r in bm25.mine_negatives(df, "query_text", "gold_passage", n=n, prune=True).collect()}
        assert plain == pruned and all(g not in m for (_, g), m in plain.items())


def test_open_bounds_in_the_report(spark):
    df = spark.createDataFrame([("a long enough query", "a passage that is long enough", "other")],
                               "query_text string, gold_passage string, hard_negative string")
    for bounds in ({"query_text": (5, None)}, {"query_text": (None, 99)}, {"query_text": (None, None)}):
        report = {r.step: r.rows for r in clean.retention_report(df, bounds).collect()}
        assert report["not_identical"] == clean.clean_dataset(df, bounds).count() == 1


def test_row_keys_tell_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("a", "a"), ("", None), (None, None)], "x string, y string")
    got = profile.duplicate_profile(df).first()
    assert (got.rows, got.duplicates) == (6, 1)


def test_neighbour_of_null_key_across_ranges(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 5000, "b"), ("k", 1, "c"), ("k", 9000, "d")], "k string, i long, v string")
    got = {(r.k, r.i): r.next_v for r in ordering.neighbor_within(df, ["k"], "i", ["v"]).collect()}
    assert got == {(None, 1): "b", (None, 5000): None, ("k", 1): "d", ("k", 9000): None}


def test_failed_batches_keep_their_rows(spark):
    def failing_encoder():
        def encode(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("no")
            return np.ones((len(texts), 3))
        return encode

    df = spark.createDataFrame([("bad",), ("x",), ("y",), ("z",), ("u",), ("v",)], "t string").coalesce(1)
    zero = dense.embed_batches(df, "t", failing_encoder, batch_size=2, on_error="zero", dim=3, error="why").collect()
    assert [(r.t, r.embedding, r.why) for r in zero][:2] == [("bad", [0.0] * 3, "ValueError: no"), ("x", [0.0] * 3, "ValueError: no")]
    assert len(zero) == 6 and [r.embedding for r in zero[2:]] == [[1.0] * 3] * 4
    assert dense.embed_batches(df, "t", failing_encoder, batch_size=2).count() == 4
    told = dense.embed_batches(df, "t", failing_encoder, batch_size=2, error="why")
    assert told.count() == 6 and told.filter("why is not null").count() == 2
    assert [r.embedding for r in dense.embed_batches(df, "t", failing_encoder, batch_size=2, on_error="zero").collect()][:2] == [[0.0] * 3] * 2


@pytest.mark.parametrize("block_bytes", [16, 200, 1 << 20])
def test_blocks_change_nothing(spark, block_bytes):
    rng = np.random.default_rng(0)
    qs, ps = rng.normal(size=(13, 4)), rng.normal(size=(29, 4))
    q = spark.createDataFrame([("m", i, v.tolist(), f"p{i:02}") for i, v in enumerate(qs)], "s string, qid int, qvec array<double>, gold_pid string")
    p = spark.createDataFrame([("m", f"p{i:02}", v.tolist()) for i, v in enumerate(ps)] + [("m", "p99", None)], "s string, pid string, pvec array<double>")
    S = ps @ qs.T
    top = dense.dense_topk(q, p, k=3, scope=["s"], block_bytes=block_bytes).collect()
    want = {(j, r + 1): f"p{i:02}" for j in range(13) for r, i in enumerate(np.argsort(-S[:, j])[:3])}
    assert {(r.qid, r["rank"]): r.pid for r in top} == want
    full = {r.qid: (r["rank"], r.n_scored) for r in dense.gold_rank_full(q, p, block_bytes=block_bytes).collect()}
    assert full == {j: (1 + int((S[:, j] > S[j, j]).sum()), 29) for j in range(13)}


def test_gold_that_the_corpus_holds_twice(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "g")], "qid int, qvec array<double>, gold_pid string")
    p = spark.createDataFrame([("g", [0.5, 0.0]), ("g", [0.5, 0.0]), ("a", [0.5, 0.0]), ("z", [0.9, 0.0]), ("y", [0.1, 0.0])],
                              "pid string, pvec array<double>")
    got = dense.gold_rank_full(q, p).first()
    assert (got["rank"], got.n_scored) == (3, 5)


def test_negative_column_names():
    assert grade.negative_column(["a", "neg_text", "negative"]) == "negative"
    assert grade.negative_column(["a", "MyNegatives", "neg2"]) == "MyNegatives"
    assert grade.negative_column(["a", "b"]) is None


def test_partial_grading_of_named_and_missing_columns(spark):
    df = spark.createDataFrame([("q", "some text")], "query_text string, other string")
    assert grade.grade_pairs_partial(df, 1, ["query_text"]).columns == df.columns
    got = grade.grade_pairs_partial(df, 1, ["query_text"], negative="other").first()
    assert got.llm_classification in ("hard", "regular", "unknown")


def test_failed_generation_is_counted(spark):
    def model(row):
        if row["query_text"] == "bad":
            raise RuntimeError("down")
        return "1. one\n2. two"
    df = spark.createDataFrame([("bad", "g"), ("ok", "g")], "query_text string, gold_passage string")
    assert grade.generate_negatives(df, 2, lambda: model).count() == 2
    got = grade.generation_report(df, 2, lambda: model).first()
    assert (got.calls, got.failed) == (2, 1) and "down" in got.error


def test_language_sets_must_differ(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "lang string") for s in ("ab", "bc"))
    with pytest.raises(ValueError, match="b"):
        ordering.require_disjoint(a, b)
    ordering.require_disjoint(a, b.filter(F.col("lang") == "c"))
