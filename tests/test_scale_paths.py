"""Paths that a large input takes, against plain ones on small tables."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import blockmax, bm25, dense, dense_index, grade, model_pass, ordering
from ranksmith.session import shared_dir, staged
from ranksmith.sources import files, quoted
from ranksmith.streaming import incremental


# --- block-max postings ------------------------------------------------------------------

def _texts(rnd, words, n, lo, hi):
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(lo, hi))) for _ in range(n)]


def test_block_max_equals_the_full_join(spark):
    rnd = random.Random(3)
    en = ["the", "of", "and"] * 20 + [f"e{i}" for i in range(150)]
    de = ["der", "und", "die"] * 20 + [f"d{i}" for i in range(150)]
    corpus = spark.createDataFrame([(t,) for t in {*_texts(rnd, en, 90, 3, 25), *_texts(rnd, de, 90, 3, 25)}], "passage string")
    q = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(rnd, en, 12, 1, 9) + _texts(rnd, de, 12, 1, 9) + ["", "no such word"])],
                              "qid int, q string")
    idx = bm25.bm25_index(corpus)
    want = bm25._ranked(bm25.bm25_scores(idx, q, ["qid"], "q"), idx, ["qid"], 5)
    for block_docs in (8, 4096):
        got = bm25.bm25_topk(idx, q, ["qid"], "q", k=5, block_docs=block_docs)
        assert sorted((r.qid, r["rank"], r.passage) for r in got.collect()) == sorted((r.qid, r["rank"], r.passage) for r in want.collect())


def test_block_rows_are_fewer_than_posting_rows(spark):
    rnd = random.Random(4)
    words = ["the", "of", "and"] * 40 + [f"w{i}" for i in range(200)]
    corpus = spark.createDataFrame([(t,) for t in set(_texts(rnd, words, 300, 5, 30))], "passage string")
    q = spark.createDataFrame([(i, t) for i, t in enumerate(_texts(rnd, words, 20, 3, 9))], "qid int, q string")
    r = blockmax.block_report(bm25.bm25_index(corpus), q, ["qid"], "q", block_docs=64).first()
    assert 0 < r.block_rows * 3 <= r.posting_rows


def test_null_scope_is_a_scope(spark):
    rows = [(None, "red fish", "red fish swims", "x"), (None, "blue bird", "blue bird sings", "x"), ("en", "red fish", "red fish here", "x"),
            ("en", "sun", "the sun and red fish", "x")]
    df = spark.createDataFrame(rows, "lang string, query_text string, gold_passage string, hard_negative string")
    out = {(r.lang, r.query_text): r.hard_negative for r in bm25.bm25_hard_negatives(df, scope=["lang"]).collect()}
    assert out[(None, "red fish")] in ("blue bird sings", "x") and out[(None, "blue bird")] in ("red fish swims", "x")
    assert out[("en", "red fish")] == "the sun and red fish"
    plain = bm25.bm25_hard_negatives(df.filter("lang is null").drop("lang"))
    assert {r.query_text: r.hard_negative for r in plain.collect()} == {q: n for (g, q), n in out.items() if g is None}


# --- cluster-bounded dense search -----------------------------------------------------------

def _vectors(spark, n, seed, scope=None):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, 8)) * 4
    x = centers[rng.integers(0, 6, n)] + rng.normal(size=(n, 8)) * 0.2
    rows = [(i, *([scope[i % len(scope)]] if scope else []), [float(v) for v in x[i]]) for i in range(n)] + [(n, *([scope[0]] if scope else []), [0.0] * 8)]
    return spark.createDataFrame(rows, "id long, " + ("s string, " if scope else "") + "v array<double>")


@pytest.mark.parametrize("scope", [None, ["a", "b"]])
def test_index_equals_scan(spark, scope):
    v = staged(_vectors(spark, 400, 1, scope), "test-vectors")
    sc = ["s"] if scope else []
    index = dense_index.cluster_index(v, "id", "v", sc, block_rows=16)
    q = v.filter("id % 20 = 0")
    kw = dict(k=5, qid="qid", pid="id", qvec="v", pvec="v", scope=sc, other_than_self=True)
    q = q.withColumnRenamed("id", "qid")
    rows = lambda df: sorted((r.qid, r["rank"], r.id) for r in df.collect())
    assert rows(dense.dense_topk(q, v, index=index, **kw)) == rows(dense.dense_topk(q, v, **kw))
    gold = q.withColumn("gold", (F.col("qid") + 2 * len(scope or [1])) % 400)
    kw = dict(qid="qid", qvec="v", gold="gold", pid="id", pvec="v", scope=sc, other_than_self=True)
    ranks = lambda df: sorted((r.qid, r["rank"], r.n_scored) for r in df.collect())
    assert ranks(dense.gold_rank_full(gold, v, index=index, **kw)) == ranks(dense.gold_rank_full(gold, v, **kw))


def test_blocks_are_skipped(spark):
    v = staged(_vectors(spark, 600, 2), "test-vectors")
    index = dense_index.cluster_index(v, "id", "v", block_rows=32)
    q = staged(v.filter("id % 50 = 0").select(F.col("id").alias("_id"), F.col("v").alias("_vec")), "test-queries")
    r = dense_index.visit_report(q, index, 5).first()
    assert 0 < r.n_first < r.n_pairs / 4


def test_norm_is_bound_once(spark):
    from ranksmith.functions.vector import normalize_vector
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r.v for r in df.select(normalize_vector("v").alias("v")).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    plan = df.select(normalize_vector("v").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


# --- model pass -----------------------------------------------------------------------------

def test_batch_model_isolates_bad_rows(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def call(columns):
            calls.add(len(columns["x"]))
            if "bad" in columns["x"]:
                raise RuntimeError("down")
            return [ValueError("odd") if v == "odd" else v.upper() if v else None for v in columns["x"]]
        return call

    values = ["a", "bad", "b", "odd", None, "c", "d", "bad"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").coalesce(1)
    done = model_pass.run_model(df, model_pass.batched(make, 8), ["x"], retries=2)
    asked = calls.value
    assert {r.i: r.reply for r in done.replies.collect()} == {0: "A", 2: "B", 4: None, 5: "C", 6: "D"}
    assert {r.i: r.error for r in done.dead_letters.collect()} == {1: "RuntimeError: down", 3: "ValueError: odd", 7: "RuntimeError: down"}
    r = done.report().first()
    assert (r.calls, r.failed) == (8, 3) and sorted((e.error, e.n) for e in done.errors().collect())[0] == ("RuntimeError: down", 2)
    assert calls.value == asked  # counted without another call


def test_generation_is_called_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def call(row):
            calls.add(1)
            if row["query_text"] == "bad":
                raise RuntimeError("down")
            return "1. one\n2. two"
        return call

    df = spark.createDataFrame([("bad", "g"), ("ok", "g")], "query_text string, gold_passage string")
    made, done = grade.generation_pass(df, 2, model)
    assert made.count() == 2 and done.dead_letters.first().query_text == "bad" and done.report().first().failed == 1
    assert calls.value == 1 + 3  # one row answered, one tried three times


def test_failed_texts_are_kept_apart(spark):
    def encoder():
        def encode(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("down")
            return np.array([[float(len(t)), 1.0] for t in texts])
        return encode

    df = spark.createDataFrame([(t,) for t in ("a", "bad", "ccc")], "t string").coalesce(1)
    done = dense.embed_pass(df, "t", encoder, batch_size=1)
    assert sorted(r.t for r in done.replies.collect()) == ["a", "ccc"] and done.report().first().failed == 1
    assert done.dead_letters.first().error == "RuntimeError: down"
    path = shared_dir(spark, "nearest")
    near = dense.nearest_texts(df, df.withColumnRenamed("t", "p"), encoder, k=1, query="t", passage="p", path=path)
    assert near.count() <= 3 and files.path_exists(spark, f"{path}/passages")


# --- resumable scoring ----------------------------------------------------------------------

def test_killed_between_write_and_commit(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(60)], "k string, v int").repartition(3)
    out, scored = shared_dir(spark, "killed"), []

    def scorer(batch):
        scored.extend(r.k for r in batch.collect())
        return batch.withColumn("s", F.col("v") * 2)

    commit, n = incremental.Manifest.commit, []

    def killed(self, batch):
        n.append(batch)
        if len(n) == 2:
            raise KeyboardInterrupt
        commit(self, batch)

    monkeypatch.setattr(incremental.Manifest, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        incremental.resume_scoring(df, "k", scorer, out, batch_rows=10)
    monkeypatch.undo()
    before = list(scored)
    again = incremental.resume_scoring(df, "k", scorer, out, batch_rows=10)
    assert again > 0 and not set(before) & set(scored[len(before):])
    assert sorted(scored) == sorted(f"k{i}" for i in range(60))
    assert sorted(r.k for r in incremental.read_scored(spark, out).collect()) == sorted(scored)
    assert incremental.Manifest(spark, out).open_plan() is None


def test_batches_are_bounded_by_bytes(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v")).repartition(8)
    out, sizes = shared_dir(spark, "bytes"), []
    n = incremental.resume_scoring(df, "k", lambda b: (sizes.append(b.count()), b)[1], out, batch_bytes=100_000)
    assert n > 2 and sum(sizes) == 4000 and incremental.read_scored(spark, out).count() == 4000


# --- quoted text ----------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quoted_text_by_ranges(spark, tmp_path, seed):
    rnd = random.Random(seed)
    pieces = ["a", "b ", '"', "\n", "\t", "", " x", "é", "\n\n", '""', ","]
    rows = [["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8))) for _ in range(3)] for _ in range(400)]
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    with open(tmp_path / "f.tsv", "w") as f:
        f.write("q\tp\tn\n")
        f.writelines("\t".join(quote(x) if set(x) & set('"\n\t') or rnd.random() < 0.5 else x for x in r) + "\n" for r in rows)
    how = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true", "header": "true", "ignoreLeadingWhiteSpace": "false",
           "ignoreTrailingWhiteSpace": "false"}
    want = spark.read.options(**how).schema("q string, p string, n string").csv(str(tmp_path)).collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = quoted.read_records(spark, str(tmp_path), ["q", "p", "n"], header=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 300


def test_empty_field_too_many_is_rejected(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('a\tb\tc\t\na\tb\tc\n"x\ty"\tb\tc\na\n')
    ok, bad = files.read_headerless_tsv(spark, str(tmp_path), ["x", "y", "z"])
    assert sorted(map(tuple, ok.collect()), key=str) == sorted([("a", "b", "c"), ("x\ty", "b", "c"), ("a", None, None)], key=str)
    assert [tuple(r) for r in files.headerless_rejects(bad).collect()] == [(4, 1, "a\tb\tc\t")]


# --- order ----------------------------------------------------------------------------------

def test_ranks_of_a_hot_query(spark):
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), rnd.choice([0.1, 0.5, 0.9, None]), f"t{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "q string, s double, t string")
    got = ordering.rank_per_query(df, ["q"], "s", "t")
    assert got.columns == ["q", "s", "t", "rank"]
    want = {}
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want.update({r[2]: i for i, r in enumerate(own, 1)})
    assert {r.t: r["rank"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan  # numbered within ranges, not within the query


def test_flags_of_the_first_rows(spark):
    rows = [(i % 7 if i % 5 else None, i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b int")
    for n in (0, 1, 13, 50, 80):
        got = ordering.flag_first(df, n, ["a", "b"], "first").collect()
        assert len(got) == 50
        key = lambda r: (r.a is not None, r.a or 0, r.b)
        assert sorted(map(key, (r for r in got if r.first))) == sorted(map(key, got))[:n]


# --- code on the executors ------------------------------------------------------------------

def test_dense_search_from_another_folder(tmp_path):
    """The package is found by the driver alone; tasks get it from Spark."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from ranksmith.operators import dense
from ranksmith.session import local_session
spark = local_session(2, 2)
v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "pid long, pvec array<double>")
got = dense.dense_topk(v.selectExpr("pid as qid", "pvec as qvec"), v, k=1)
assert sorted((r.qid, r.pid) for r in got.collect()) == [(1, 1), (2, 2)]
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-2000:]
