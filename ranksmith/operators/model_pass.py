"""One pass of a pluggable model over a table, with dead letters.

A *row model* is a factory ``() -> call`` with ``call(row: dict) -> str``.  A
*batch model* is ``batched(factory, size)`` with ``call(columns: dict of lists)
-> list``: one reply a row, or an exception in its place where that row failed.
The factory runs once a task, to open a client or load weights; only the
model's own columns are handed to it, the others pass by as Arrow arrays.

A batch call that fails as a whole is tried again, then cut in halves until the
failing rows stand alone, so that a bad row costs its neighbours nothing and no
row is lost: it ends up with a null reply, ``success`` false and its error.

``run_model`` writes replies and failures in one job, apart from each other, so
that failures are counted and read without another call.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, ship_package

RowModel = Callable[[], Callable[[dict], str]]

#: Bytes of a model's columns that are Python objects at a time, where one row
#: does not exceed them.
CALL_BYTES = 4 << 20


@dataclass(frozen=True)
class BatchModel:
    """A model that answers up to ``size`` rows a call."""

    make: Callable[[], Callable[[dict], Sequence]]
    size: int = 64


def batched(make: Callable[[], Callable[[dict], Sequence]], size: int = 64) -> BatchModel:
    return BatchModel(make, size)


Model = RowModel | BatchModel


def _by_rows(call: Callable[[dict], str]) -> Callable[[dict], list]:
    """A row model's call, over columns."""
    def over(columns: dict) -> list:
        out = []
        for values in zip(*columns.values()):
            try:
                out.append(call(dict(zip(columns, values))))
            except Exception as e:  # noqa: BLE001 - a failed call is data
                out.append(e)
        return out
    return over


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def answer(call: Callable[[dict], Sequence], columns: dict, retries: int = 3, delay: float = 0.0) -> list[tuple]:
    """(reply, error) of each row; one of the two is null.  Rows that failed
    are asked again, at most ``retries`` times in all."""
    n = len(next(iter(columns.values()), []))
    out: list[tuple] = [(None, None)] * n
    todo = list(range(n))
    for attempt in range(max(1, retries)):
        if attempt and delay:
            time.sleep(delay)
        try:
            got = call({c: [v[i] for i in todo] for c, v in columns.items()})
            if len(got) != len(todo):
                raise ValueError(f"{len(got)} replies to {len(todo)} rows")
        except Exception as e:  # noqa: BLE001
            got = [e] * len(todo)
            whole = len(todo) > 1
        else:
            whole = False
        for i, reply in zip(todo, got):
            out[i] = (None, _said(reply)) if isinstance(reply, Exception) else (reply, None)
        todo = [i for i in todo if out[i][1] is not None]
        if not todo:
            break
    if todo and whole:  # the last call fell as a whole: find the rows that did it
        half = len(todo) // 2
        for some in (todo[:half], todo[half:]):
            for i, said in zip(some, answer(call, {c: [v[i] for i in some] for c, v in columns.items()}, 1, delay)):
                out[i] = said
    return out


def _bytes(column: pa.Array) -> np.ndarray:
    """About the bytes of each row."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(column.type) and pa.types.is_string(column.type.value_type):
        of = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
        return np.bincount(of, weights=_bytes(column.flatten()), minlength=len(column)).astype(np.int64)
    return np.full(len(column), 8, np.int64)


def pieces(batch: pa.RecordBatch, columns: Sequence[str], size: int):
    """(first row, rows) of pieces with up to ``size`` rows and about
    ``CALL_BYTES`` in ``columns``."""
    end = np.cumsum(sum((_bytes(batch.column(c)) for c in columns), np.zeros(len(batch), np.int64)))
    lo = 0
    while lo < len(batch):
        before = end[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(end, before + CALL_BYTES, side="right")), lo + 1), lo + size, len(batch))
        yield lo, hi - lo
        lo = hi


def call_model(df: DataFrame, model: Model, inputs: Sequence[str] | Mapping[str, str], retries: int = 3,
               retry_delay: float = 0.0, out: str = "reply") -> DataFrame:
    """Append ``out`` (the reply), ``success`` and ``error``.  ``inputs`` names
    the columns the model gets, or maps its field names to columns."""
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [
        T.StructField(out, T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType())])
    fields = dict(inputs) if isinstance(inputs, Mapping) else {c: c for c in inputs}
    size = model.size if isinstance(model, BatchModel) else 1024

    def run(batches):
        call = model.make() if isinstance(model, BatchModel) else _by_rows(model())
        for batch in batches:
            for lo, rows in pieces(batch, list(fields.values()), size):
                part = batch.slice(lo, rows)
                said = answer(call, {f: part.column(c).to_pylist() for f, c in fields.items()}, retries, retry_delay)
                made = [pa.array([r for r, _ in said], pa.string()), pa.array([e is None for _, e in said], pa.bool_()),
                        pa.array([e for _, e in said], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


@dataclass
class ModelPass:
    """What a pass wrote: ``replies`` of the rows that the model answered and
    ``dead_letters`` of those it failed on (with ``error``)."""

    replies: DataFrame
    dead_letters: DataFrame

    def report(self) -> DataFrame:
        """One row: ``calls``, ``failed``, and one of the messages."""
        sides = [side.select(F.lit(failed).alias("failed"), "error") for side, failed in ((self.replies, 0), (self.dead_letters, 1))]
        return sides[0].unionByName(sides[1]).agg(
            F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.max("error").alias("error"))

    def errors(self) -> DataFrame:
        """``(error, n)``: how often each message came."""
        return self.dead_letters.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def run_model(df: DataFrame, model: Model, inputs: Sequence[str] | Mapping[str, str], path: str | None = None,
              **kw) -> ModelPass:
    """``call_model`` once over ``df``, replies and failures written to two
    folders of ``path`` (default: the shared folder) by one job."""
    return split_pass(call_model(df, model, inputs, **kw), path)


def split_pass(called: DataFrame, path: str | None = None) -> ModelPass:
    """A frame with ``success``, written once and read as two."""
    spark = called.sparkSession
    path = path or shared_dir(spark, "model-pass")
    schema = called.schema
    called.withColumn("answered", F.col("success").cast("int")).write.mode("overwrite").partitionBy("answered").parquet(path)
    return read_pass(spark, path, schema)


def read_pass(spark: SparkSession, path: str, schema: T.StructType) -> ModelPass:
    """A pass that was written to ``path``, of rows of this schema."""
    back = spark.read.schema(T.StructType([*schema.fields, T.StructField("answered", T.IntegerType())])).parquet(path)
    return ModelPass(*(back.where(F.col("answered") == side).select(*schema.names) for side in (1, 0)))
