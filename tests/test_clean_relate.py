"""Cleaning edge rows, qrels joins, containment join and neighbours."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ranksmith.operators import clean, ordering, profile, relate

TRIP = "query_text string, gold_passage string, hard_negative string"


def test_clean_dataset_edges(spark):
    g20, g2048 = "g" * 20, "g" * 2048
    rows = [
        (None, g20, "n"), ("q" * 10, None, "n"), ("q" * 10, g20, None),          # nulls
        ("\t 　" * 4, g20, "n"),                                        # blank after unicode strip
        ("q" * 9, g20, "n"), ("q" * 10, g20, "n"), ("q" * 512, g20, "n"), ("q" * 513, g20, "n"),
        ("q" * 11, "g" * 19, "n"), ("q" * 11, g2048, "n"), ("q" * 11, "g" * 2049, "n"),
        ("q" * 12, g20, g20),                                                    # negative == gold
        ("q" * 10, g20, "n"),                                                    # duplicate
        ("\U0001F600" * 10, g20, "n"),                                           # 10 code points
    ]
    df = spark.createDataFrame(rows, TRIP)
    got = sorted((len(r.query_text), len(r.gold_passage)) for r in clean.clean_dataset(df).collect())
    assert got == [(10, 20), (10, 20), (11, 2048), (512, 20)]
    rep = {r.step: r.rows for r in clean.retention_report(df).collect()}
    assert rep == {"input": 14, "not_null": 11, "distinct": 10, "non_blank": 9, "length": 5, "not_identical": 4}


def test_retention_report_empty_input(spark):
    df = spark.createDataFrame([], TRIP)
    assert all(r.retained_pct is None for r in clean.retention_report(df).collect())


def test_preprocess_training_has_no_distinct(spark):
    df = spark.createDataFrame([(" hello ", "gold text", "neg"), (" hello ", "gold text", "neg")], TRIP)
    out = clean.preprocess_training(df).collect()
    assert len(out) == 2 and out[0].query_text == "hello"


def test_profiles(spark):
    df = spark.createDataFrame([("aa", "bbbb", None), ("aa", "bbbb", None), ("cccc", "bbbb", "bbbb")], TRIP)
    nulls = {r.column: r.nulls for r in profile.null_profile(df).collect()}
    assert nulls == {"query_text": 0, "gold_passage": 0, "hard_negative": 2, "*": 2}
    assert profile.duplicate_profile(df).first().duplicates == 1
    assert profile.identical_pair_count(df).first().identical == 1
    lp = {r.column: r for r in profile.length_profile(df).collect()}
    assert lp["query_text"].median == 2.0 and lp["query_text"].q75 == 3.0


def test_qrels_joins(spark):
    q = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, text string")        # int ids
    c = spark.createDataFrame([("10", "p10"), ("11", "p11")], "corpus_id string, text string")
    r = spark.createDataFrame([("1", "10", 1), ("1", "11", 0), ("2", "99", 1), ("3", "10", 1)],
                              "query_id string, corpus_id string, score int")
    inner = sorted(tuple(x) for x in relate.join_qrels_inner(r, q, c).collect())
    assert inner == [("q1", "p10"), ("q1", "p11")]                      # two positives, score 0 kept
    kept = relate.qrels_referential_filter(r, q, c).count()
    orph = {x.side: (x.present, x.absent) for x in relate.qrels_orphans(r, q, c).collect()}
    assert kept == 2 and orph == {"query": (3, 1), "corpus": (3, 1)}


def test_substring_containment_join_brute_force(spark):
    rnd = random.Random(5)
    alphabet = "ab c"
    docs = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120))) for _ in range(40)]
    needles = [d[s:s + n] for d in docs[:15] for s, n in [(rnd.randint(0, 20), rnd.choice([1, 3, 8, 9, 20, 60]))]]
    needles += ["zzz", "ab c ab"]
    nd = spark.createDataFrame(list(enumerate(needles)), "nid int, needle string")
    dd = spark.createDataFrame(list(enumerate(docs)), "did int, text string")
    got = {(r.nid, r.did) for r in relate.substring_containment_join(nd, "needle", dd, "text").collect()}
    want = {(i, j) for i, n in enumerate(needles) for j, d in enumerate(docs) if n and n in d}
    assert got == want


def test_neighbor_within_matches_window(spark):
    rnd = random.Random(1)
    rows = [(k, o, f"v{k}-{o}") for k in ("a", "b") for o in rnd.sample(range(0, 500), 60)]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    w = Window.partitionBy("k").orderBy("o")
    want = {(r.k, r.o): (r.n, r.p) for r in df.select("k", "o", F.lead("v").over(w).alias("n"),
                                                      F.lag("v").over(w).alias("p")).collect()}
    nxt = ordering.neighbor_within(df, ["k"], "o", ["v"], bucket_width=16)
    prv = ordering.neighbor_within(df, ["k"], "o", ["v"], prefix="prev_", previous=True, bucket_width=16)
    got_n = {(r.k, r.o): r.next_v for r in nxt.collect()}
    got_p = {(r.k, r.o): r.prev_v for r in prv.collect()}
    assert all(got_n[x] == want[x][0] and got_p[x] == want[x][1] for x in want)


def test_sample_per_group_exact_and_repeatable(spark):
    df = spark.createDataFrame([("x" if i % 3 else "y", f"t{i}") for i in range(90)], "lang string, t string")
    a = ordering.sample_per_group(df, "lang", 20, F.col("t"))
    counts = {r.lang: r["count"] for r in a.groupBy("lang").count().collect()}
    assert counts == {"x": 20, "y": 20}
    b = ordering.sample_per_group(df.repartition(7), "lang", 20, F.col("t"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_top_and_bottom(spark):
    df = spark.createDataFrame([(f"q{i}", f"n{i}", i / 10) for i in range(10)],
                               "query_text string, hard_negative string, rag_score double")
    t = {(r.end, r.rag_score) for r in ordering.top_and_bottom(df, 2).collect()}
    assert t == {("top", 0.9), ("top", 0.8), ("bottom", 0.0), ("bottom", 0.1)}
