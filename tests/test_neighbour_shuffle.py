"""Neighbours: only boundary rows of a range meet the summary of ranges."""

from pyspark.sql import functions as F

from ranksmith.operators.ordering import neighbor_within


def test_rows_are_shuffled_once(spark):
    rows = [(k, i, f"{k}{i}") for k in ("a", None) for i in (0, 1, 3, 9, 10, 30, 31)] + [("b", None, "x"), ("b", 2, "y"), ("b", 2, "y")]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    nb = neighbor_within(df, ["k"], "o", ["t"], bucket_width=4)
    assert nb.count() == len(rows)
    got = {(r.k, r.o): r.next_t for r in nb.filter("o is not null and (k is null or k <> 'b')").collect()}
    for k in ("a", None):
        own = [0, 1, 3, 9, 10, 30, 31]
        assert [got[k, i] for i in own] == [*(f"{k}{i}" for i in own[1:]), None]
    assert sorted(str(r.next_t) for r in nb.filter("k = 'b' and o = 2").collect()) == ["None", "y"]
    text = nb._jdf.queryExecution().optimizedPlan().toString()
    side = text[text.index("Join LeftOuter"):].splitlines()[1]
    assert "Filter isnull(_nb" in text and side.strip(" :+-").startswith(("Project", "Filter"))
