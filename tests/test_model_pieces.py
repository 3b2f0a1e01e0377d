"""What a model pass holds as Python objects is bounded in bytes."""

import pyarrow as pa

from ranksmith.operators import grade, model_pass


def test_pieces_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(model_pass, "CALL_BYTES", 100)
    texts = ["a" * 60, "b" * 60, None, "", "c" * 500, "d"] + ["e"] * 40
    batch = pa.RecordBatch.from_pydict({"t": texts, "l": [[t] if t else None for t in texts]})
    got = list(model_pass.pieces(batch, ["t"], 16))
    assert [lo for lo, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))] and sum(n for _, n in got) == len(texts)
    for lo, n in got:
        assert n == 1 or sum(len(t or "") for t in texts[lo:lo + n]) <= 100 and n <= 16
    assert len(list(model_pass.pieces(batch, ["t", "l"], 16))) >= len(got)
    assert list(model_pass.pieces(batch.slice(0, 0), ["t"], 16)) == []


def test_whole_fields_are_no_copies(spark):
    df = spark.createDataFrame([("q", "g", "n")], "query_text string, gold_passage string, hard_negative string")
    plan = grade.grade_negatives(df, widths=None)._jdf.queryExecution().analyzed().toString()
    assert "_rs_" not in plan
    assert grade.grade_negatives(df, widths=None).first().hard_negative == "n"
