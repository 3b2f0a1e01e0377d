"""Ranked lexical search against scores counted term by term."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(docs, items, k=20):
    """(item, rank, doc, score) by the formula, document by document."""
    counted = [(i, terms(t)) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c in counted:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in terms(text).items() if c[t])
            if s > 0:
                found.append((-s, i is None, i, s))
        found.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, n, r[2], r[3]) for n, r in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_terms():
    text = "Ünï-code ABC abc x1_y2\x7f日本  é"
    assert lexical.count_terms(text.encode()) == Counter({t.encode(): n for t, n in terms(text).items()})
    long = ("word " * 1000 + "x" * 5000 + "-") * 3
    old, lexical._SLICE = lexical._SLICE, 700
    try:
        assert lexical.count_terms(long.encode()) == Counter({t.encode(): n for t, n in terms(long).items()})
    finally:
        lexical._SLICE = old
    assert not lexical.count_terms(None) and not lexical.count_terms(b" .,- ")


def test_sketch_bounds_the_score():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}".encode() for i in range(400)]
    old, lexical.BITS = lexical.BITS, 6  # many terms share a coordinate
    try:
        docs = [Counter(rng.choice(vocabulary, rng.integers(1, 80)).tolist()) for _ in range(60)]
        items = [Counter(rng.choice(vocabulary, 12).tolist()) for _ in range(15)]
        df = dict(Counter(t for d in docs for t in d))
        q = lexical.Queries(items, df, len(docs), sum(d.total() for d in docs))
        import pyarrow as pa
        made = [lexical.sketch(d) for d in docs]
        batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array([d.total() for d in docs]),
                                            pa.array([a for a, _ in made], pa.binary()), pa.array([t for _, t in made], pa.binary())],
                                           names=["k1", "k2", "n", "at", "tf"])
        bounds = q.bounds(batch)
        part = q.bounds(batch.slice(7, 20))
        for d in range(60):
            for i in range(15):
                assert bounds[d, i] >= q.score(docs[d], i)
        assert (part == bounds[7:27]).all()
    finally:
        lexical.BITS = old


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 60])
def test_search_by_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of"] * 30 + [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60)))) for i in range(150)]
    docs += [(1000 + i, "same text the w1 w2") for i in range(60)] + [(7, "same text the w1 w2"), (None, "the w5"), (500, None), (501, " "), (7, docs[7][1])]
    items = [(i, " ".join(rng.choice(vocabulary, 8))) for i in range(6)] + [(10, "same text w1 w1"), (10, "same text w1 w1"), (11, None), (12, "unknown"),
                                                                         (None, "the w5"), (13, "W2 the THE")]
    assert rows(lexical.search(*frames(spark, docs, items))) == brute(docs, items)


def test_fewer_hits_than_places(spark):
    docs, items = [(1, "rare word"), (2, "rare"), (3, "other")], [(1, "rare"), (2, "nothing here")]
    assert rows(lexical.search(*frames(spark, docs, items))) == brute(docs, items)


def test_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "hello world"), (2, "text")], "item_id long, text string").withColumn("rank", F.lit(9))
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows(lexical.search(odd_docs, items)) == brute(docs, [(1, "hello world"), (2, "text")])
    empty = lexical.search(no_docs, items)
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
    assert lexical.search(odd_docs, items.limit(0)).count() == 0


def test_index_is_reused(spark, odd_docs):
    from ranksmith.llm.common import staged
    items = spark.createDataFrame([(1, "hello")], "item_id long, text string")
    index = staged(lexical.build_index(odd_docs), "test-index")
    assert rows(lexical.search(odd_docs, items, index=index)) == rows(lexical.search(odd_docs, items))
