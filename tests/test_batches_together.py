"""Batches of a resumable pass run together."""

import threading

from pyspark.sql import functions as F

from ranksmith.session import shared_dir
from ranksmith.streaming import incremental


def test_batches_run_together(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("k")).coalesce(1)
    out, met = shared_dir(spark, "together"), threading.Barrier(2, timeout=60)

    def scorer(batch):
        met.wait()  # alone, it would wait in vain
        return batch

    assert incremental.resume_scoring(df, "k", scorer, out, batch_rows=15, at_a_time=2) == 4
    assert incremental.read_scored(spark, out).count() == 60
    assert incremental.Manifest(spark, out).open_plan() is None
    one = shared_dir(spark, "one")
    assert incremental.resume_scoring(df, "k", lambda b: b, one, batch_rows=15, stop_after=1) == 1
    assert incremental.resume_scoring(df, "k", lambda b: b, one, batch_rows=15) == 3
    assert incremental.read_scored(spark, one).distinct().count() == 60
