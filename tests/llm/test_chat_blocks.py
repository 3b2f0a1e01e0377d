"""Blocks of a conversation hold a bounded number of rows."""
from pyspark.sql import functions as F

from ranksmith.llm import chat


def test_blocks_are_bounded_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    rows = ([(1, 0, "u", f"t{i}") for i in range(60)] + [(1, 1, "u", "equal")] * 60 + [(1, 2 + i // 3, "u", f"s{i}") for i in range(30)]
            + [(1, None, "u", f"n{i}") for i in range(40)] + [(2, 0, "u", "short"), (None, 0, "u", "x")])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = chat.turns(df).groupBy("conv", "block").count().agg(F.max("count"), F.sum("count")).first()
    assert held[0] <= 8 * 2 and held[1] == len(rows)
    got = {}
    for r in sorted(chat.render(df).collect(), key=lambda r: r.part):
        got[r.conv_id] = got.get(r.conv_id, "") + r.chat
    plain = chat.turns(df).where("conv = 1").select("turn", "m", "role", "text").collect()
    plain.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.m))
    assert got[1] == "".join(f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n" for r in plain)
    assert set(got) == {1, 2, None}
