"""Queries for resumable scoring and
the user-function surface (``udf_surface``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, grade, model_pass
from ..session import shared_dir
from ..sources import testdata as td
from ..streaming import incremental
from .clean_queries import _CLEAN_SQL
from .grade_queries import _graded_sql
from .registry import query, r6
from .relations_sql import tok_sql, with_rel


def _score(batch):
    g = grade.grade_negatives(batch, grade.overlap_grader)
    return g.select("row_key", "lang", F.md5("query_text").alias("query_md5"),
                    F.md5("hard_negative").alias("neg_md5"), r6(F.col("hardness_score")).alias("hardness_score"))


def _keyed(spark, sf_dir):
    c = clean.clean_dataset(td.dirty(spark, sf_dir))
    return c.withColumn("row_key", F.md5(F.concat_ws("\u0001", "lang", "query_text", "gold_passage", "hard_negative")))


_CHECK_SQL = with_rel(f"""
WITH cd AS ({_CLEAN_SQL}), g AS ({_graded_sql('cd')})
SELECT lang, md5(query_text) AS query_md5, md5(hard_negative) AS neg_md5, round(hardness_score, 6) AS hardness_score
FROM g""", "DIRTY")


@query("checkpointed_scoring", _CHECK_SQL)
def q_checkpointed_scoring(spark, sf_dir):
    """Anti-join resume: a first run stops after one batch (a crash), the
    second run scores only the keys not yet written."""
    rows = _keyed(spark, sf_dir)
    out = shared_dir(spark, "resume")
    incremental.resume_scoring(rows, "row_key", _score, out, batch_rows=2000, stop_after=1)
    incremental.resume_scoring(rows, "row_key", _score, out, batch_rows=2000)
    return incremental.read_scored(spark, out).drop("row_key")


@query("checkpointed_scoring_stream", _CHECK_SQL)
def q_checkpointed_scoring_stream(spark, sf_dir):
    """Streaming form: input arrives in two drops of files; each
    ``availableNow`` run scores only the files its checkpoint has not seen."""
    rows = _keyed(spark, sf_dir)
    root = shared_dir(spark, "stream")
    half = F.pmod(F.xxhash64("row_key"), F.lit(2))
    rows.filter(half == 0).write.parquet(f"{root}/input/drop=0")
    schema = rows.schema
    src = f"{root}/input/*"
    incremental.stream_scoring(spark, src, schema, _score, f"{root}/out", f"{root}/checkpoint")
    rows.filter(half == 1).write.parquet(f"{root}/input/drop=1")
    incremental.stream_scoring(spark, src, schema, _score, f"{root}/out", f"{root}/checkpoint")
    return incremental.read_scored(spark, f"{root}/out").drop("row_key")


def token_counter():
    """Example of a user's model: many rows a call, one reply a row."""
    def call(columns):
        return [str(len(t.lower().split())) if t else "0" for t in columns["text"]]
    return call


@query("udf_surface", f"SELECT item_id, CAST(len({tok_sql('text')}) AS BIGINT) AS n_tokens FROM benchmark")
def q_udf_surface(spark, sf_dir):
    b = td.table(spark, sf_dir, "benchmark").select("item_id", "text")
    done = model_pass.run_model(b, model_pass.batched(token_counter), ["text"])
    return done.replies.select("item_id", F.col("reply").cast("long").alias("n_tokens"))
