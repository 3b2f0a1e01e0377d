"""Ranks of scored documents travel without the documents' texts."""

from pyspark.sql import functions as F

from ranksmith.operators import blockmax, bm25


def _scored(spark):
    texts = ["b two", "a two", "c two", "lone one", "d last", "e last", "f last"]
    index = bm25.bm25_index(spark.createDataFrame([(t,) for t in texts], "passage string"))
    score = {"lone one": 9.0, "b two": 5.0, "a two": 5.0, "c two": 5.0 + 1e-12, "d last": 1.0, "e last": 1.0, "f last": 1.0}
    scores = spark.createDataFrame([("q", t, s) for t, s in score.items()], "k string, passage string, score double")
    return index, scores.join(index.corpus, "passage").drop("passage")


def test_ties_follow_the_text_and_only_they_meet_it(spark, monkeypatch):
    index, scores = _scored(spark)
    written = []
    monkeypatch.setattr(bm25, "staged", lambda df, label, f=bm25.staged: written.append(df.columns) or f(df, label))
    for limit in (1, 3, 5, 20):
        top = bm25._places(scores, index, ["k"], limit)
        got = {r["rank"]: r.passage for r in bm25._with_passage(top, index).collect()}
        assert got == dict(enumerate(["lone one", "a two", "b two", "c two", "d last", "e last", "f last"][:limit], 1))
        assert "passage" not in top.columns
    assert len(written) == 4 and not any("passage" in c for c in written)


def test_labels_take_the_place_of_texts(spark):
    index, _ = _scored(spark)
    q = spark.createDataFrame([("x", "two last"), ("y", "one")], "k string, t string")
    whole = bm25.bm25_topk(index, q, ["k"], "t", k=4)
    named = bm25.bm25_topk(index, q, ["k"], "t", k=4, label=F.md5("passage"))
    assert "passage" not in named.columns
    rows = lambda df, c: sorted((r.k, r["rank"], r.x, round(r.score, 9)) for r in df.withColumn("x", c).collect())
    assert rows(named, F.col("label")) == rows(whole, F.md5("passage"))


def test_gold_gives_its_place_to_the_next(spark):
    rows = [("x two", "a two"), ("x two", "none of these"), ("zzz", "b two"), ("x two", "b two")]
    df = spark.createDataFrame(rows, "query_text string, gold_passage string")
    index = bm25.bm25_index(spark.createDataFrame([(t,) for t in ["a two", "b two", "c two", "other", "one more", "of four"]], "passage string"))
    for n in (1, 2):
        got = {(r.query_text, r.gold_passage): r.mined for r in bm25.mine_negatives(df, n=n, index=index).collect()}
        assert got["x two", "a two"] == ["b two", "c two"][:n]
        assert got["x two", "b two"] == ["a two", "c two"][:n]
        assert got["x two", "none of these"] == ["a two", "b two"][:n]
        assert len(got["zzz", "b two"]) == n


def test_dense_terms_are_bounded_in_cells(spark, monkeypatch):
    index, _ = _scored(spark)
    q = spark.createDataFrame([("x", "two last one")], "k string, t string")
    want = sorted((r.pid, round(r.score, 9)) for r in blockmax.best_scores(index, q, ["k"], "t", 9).collect())
    monkeypatch.setattr(blockmax, "DENSE_CELLS", 0)
    assert sorted((r.pid, round(r.score, 9)) for r in blockmax.best_scores(index, q, ["k"], "t", 9).collect()) == want
