"""Grading reads whole texts when no width is given."""
from ranksmith.operators import grade

LONG = "filler " * 60


def test_overlap_beyond_the_width(spark):
    df = spark.createDataFrame([("red", LONG + "blue", "x " * 200 + "red blue"), (None, "a", "b")],
                               "query_text string, gold_passage string, hard_negative string")
    cut = {r.query_text: r for r in grade.grade_negatives(df, keep_status=True).collect()}
    whole = {r.query_text: r for r in grade.grade_negatives(df, keep_status=True, widths=None).collect()}
    assert cut["red"].hardness_score == 0.0 and whole["red"].hardness_score == 0.67
    assert not cut[None].success and not whole[None].success
    graded, errors = grade.grade_batch(df, ["query_text"], widths=None)
    assert {r.hardness_score for r in graded.collect()} == {0.67, 0.5} and errors.count() == 1


def test_prompt_and_fields_have_the_same_widths(spark):
    def reads():
        def call(r):
            assert r["hard_negative"] in r["prompt"]
            return str(len(r["hard_negative"]) + len(r["gold_passage"]) + len(r["query_text"]))
        return call
    df = spark.createDataFrame([("q" * 9, "g" * 9, "n" * 9)], "query_text string, gold_passage string, hard_negative string")
    got = grade.grade_negatives(df, reads, widths={"query": 1, "gold": 2, "negative": None}).first()
    assert got.hardness_score == 0.12 and got.hard_negative == "n" * 9


def test_context_beyond_the_width(spark):
    df = spark.createDataFrame([("q", "g", "red", [LONG + "red", None])],
                               "query_text string, gold_passage string, hard_negative string, contexts array<string>")
    assert grade.score_with_context(df).first().rag_score == 0.0
    assert grade.score_with_context(df, widths=None).first().rag_score == 1.0
