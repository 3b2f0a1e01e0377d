"""Noisy-or scores of a table counted anew, the sentences they come from, and
token counts that leave known texts where they are."""

from __future__ import annotations

import math

import regex

from ranksmith.llm import token_counts, toxicity
from ranksmith.llm.queries import vocabulary
from ranksmith.session import shared_dir

SF = "/root/testdata/sf0.001"


def brute_score(text, weights, bias):
    """1 - prod(1 - p) over sentences, split and weighed character by character."""
    sentences, words = [], []
    for line in (text or "").split("\n"):
        for token in regex.findall(r"[^\x20\x09-\x0D]+", line):
            words += regex.findall(r"\p{L}+", token.lower())
            if token[-1] in ".!?":
                sentences.append(words)
                words = []
        sentences.append(words)
        words = []
    told = [s for s in sentences if s] or [[]]
    clean = 1.0
    for s in told:
        z = bias + sum(weights.get(w, 0.0) + sum(weights.get(w[:k] + "*", 0.0) for k in range(4, 9) if len(w) >= k) for w in s)
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_and_places(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.located(docs, model).collect()}
    assert got.keys() == texts.keys()
    spans = {}
    for r in toxicity.offending_sentences(docs, model).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.stop, r.score))
    for i, r in got.items():
        assert abs(r.score - brute_score(texts[i], model.weights, model.bias)) < 1e-4
        own = spans.get(i, [])
        assert r.n_offending == len(own)
        assert (r.worst_start, r.worst_stop) == (max(own, key=lambda s: s[2])[:2] if own else (None, None))
    assert any(r.n_offending for r in got.values())


def test_odd_texts_are_located(spark, odd_docs, no_docs):
    model = toxicity.Model({"hello": 5.0}, -2.0)
    got = toxicity.located(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and {r.n_offending for r in got if r.doc_id == 0} == {1}
    assert toxicity.located(no_docs, model).count() == 0


def test_known_texts_are_not_read_again(spark, odd_docs, monkeypatch):
    cache = shared_dir(spark, "warm")
    first = sorted(map(str, token_counts.count_tokens(odd_docs, vocabulary(), cache).collect()))
    monkeypatch.setattr(token_counts, "map_texts", lambda *a, **k: 1 / 0)
    assert sorted(map(str, token_counts.count_tokens(odd_docs, vocabulary(), cache).collect())) == first
    monkeypatch.undo()
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", 0)  # the way for many misses
    assert sorted(map(str, token_counts.count_tokens(odd_docs, vocabulary(), shared_dir(spark, "cold")).collect())) == first
