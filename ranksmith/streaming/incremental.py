"""Resumable model scoring.

Model calls are slow and fail; work already paid for must survive a crash.
Two forms:

* ``resume_scoring`` -- batch form, driven by a manifest.  What is left to do
  is written once, in files of bounded rows, and a *plan* groups these files
  into batches of bounded bytes.  A batch is *written* (its folder is
  complete) and then *committed* (a mark in the manifest).  Batches are jobs
  of their own, several run at a time.  A later run takes
  up an open plan where it stands: batches written but not committed are
  committed as they are, the rest is scored; only when no plan is open are
  the keys already there taken off the input and a new plan made.
* ``stream_scoring`` -- Structured Streaming form.  New input files are
  picked up by a file source with ``trigger(availableNow=True)``, so many
  bytes a trigger; each micro-batch is scored in ``foreachBatch`` and written
  to a folder named by its batch id (overwritten on replay, so a re-run batch
  is idempotent); progress lives in ``checkpointLocation``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.files import list_names, list_sizes, path_exists, read_text, remove, write_text

Scorer = Callable[[DataFrame], DataFrame]

#: Bytes of written input that a batch holds at most, where one file does not exceed them.
BATCH_BYTES = 64 << 20
#: Batches that run together at most.
MOST_AT_A_TIME = 4


class Manifest:
    """The state of a scored table, beside its rows in ``out_path/_manifest``
    (readers pass over names with an underscore): ``plan-*.json`` names the
    batches and their files, ``commit-*`` marks a batch, ``closed-*`` a plan."""

    def __init__(self, spark: SparkSession, out_path: str):
        self.spark, self.out, self.root = spark, out_path, f"{out_path}/_manifest"

    def _named(self, prefix: str) -> list[str]:
        return sorted(n for n in list_names(self.spark, self.root, hidden=True) if n.startswith(prefix))

    def open_plan(self) -> dict | None:
        """The plan that is not closed, if there is one."""
        closed = {n.removeprefix("closed-") for n in self._named("closed-")}
        for name in self._named("plan-"):
            if name.removeprefix("plan-").removesuffix(".json") not in closed:
                return json.loads(read_text(self.spark, f"{self.root}/{name}"))
        return None

    def make_plan(self, todo: DataFrame, batch_bytes: int, batch_rows: int) -> dict:
        """Write ``todo`` once and group its files; the plan's own file comes
        last, so a crash before it leaves no plan behind."""
        name = uuid.uuid4().hex[:12]
        folder = f"{self.root}/todo-{name}"
        todo.write.option("maxRecordsPerFile", batch_rows).parquet(folder)  # 0: no bound
        batches: list[dict] = []
        schema = T.StructType(todo.schema.fields)
        if list_names(self.spark, self.out) and self.spark.read.schema(schema).parquet(folder).isEmpty():
            return self._planned(name, folder, schema, [])
        for file, size in list_sizes(self.spark, folder):
            if not batches or batch_rows or batches[-1]["bytes"] + size > batch_bytes:
                batches.append({"id": f"{name}-{len(batches):06d}", "bytes": 0, "names": []})
            batches[-1]["bytes"] += size
            batches[-1]["names"].append(file)
        return self._planned(name, folder, schema, batches)

    def _planned(self, name: str, folder: str, schema: T.StructType, batches: list[dict]) -> dict:
        plan = {"name": name, "folder": folder, "schema": schema.json(), "batches": batches}
        write_text(self.spark, f"{self.root}/plan-{name}.json", json.dumps(plan))
        return plan

    def state(self, batch: dict) -> str:
        if path_exists(self.spark, f"{self.root}/commit-{batch['id']}"):
            return "committed"
        return "written" if path_exists(self.spark, f"{self.out}/batch={batch['id']}/_SUCCESS") else "planned"

    def states(self, plan: dict) -> dict[str, str]:
        """The state of each batch, from one listing of the marks."""
        marks = set(self._named("commit-"))
        return {b["id"]: "committed" if f"commit-{b['id']}" in marks else self.state(b) for b in plan["batches"]}

    def commit(self, batch: dict) -> None:
        write_text(self.spark, f"{self.root}/commit-{batch['id']}", json.dumps({"bytes": batch["bytes"]}))

    def close(self, plan: dict) -> None:
        write_text(self.spark, f"{self.root}/closed-{plan['name']}", "")
        remove(self.spark, plan["folder"])


def resume_scoring(df: DataFrame, key: str, scorer: Scorer, out_path: str, batch_rows: int = 0,
                   batch_bytes: int = BATCH_BYTES, stop_after: int | None = None, at_a_time: int | None = None) -> int:
    """Score the rows of ``df`` whose ``key`` is not yet in ``out_path``
    (parquet), batch by batch.  A batch has about ``batch_bytes`` of written
    input, or with ``batch_rows`` no more than so many rows.  ``stop_after``
    ends after that many batches (to exercise a resume).  Small batches leave
    most of a cluster idle, so ``at_a_time`` of them run together (default:
    the cores, up to ``MOST_AT_A_TIME``); where one fails, those begun are
    still committed.  Returns the batches scored."""
    spark = df.sparkSession
    manifest = Manifest(spark, out_path)
    plan = manifest.open_plan()
    if plan is None:
        todo = df
        if list_names(spark, out_path):  # a read that fails is an error, never "nothing done yet"
            todo = df.join(spark.read.parquet(out_path).select(key).distinct(), key, "left_anti")
        plan = manifest.make_plan(todo, batch_bytes, batch_rows)
    schema = T.StructType.fromJson(json.loads(plan["schema"]))
    states = manifest.states(plan)
    planned = [batch for batch in plan["batches"] if states[batch["id"]] == "planned"]
    for batch in plan["batches"]:
        if states[batch["id"]] == "written":
            manifest.commit(batch)

    failed = Event()  # none is begun after a failure

    def score(batch: dict) -> None:
        if failed.is_set():
            return
        try:
            part = spark.read.schema(schema).parquet(*[f"{plan['folder']}/{n}" for n in batch["names"]])
            scorer(part).write.mode("overwrite").parquet(f"{out_path}/batch={batch['id']}")
            manifest.commit(batch)
        except BaseException:
            failed.set()
            raise

    todo = planned[:stop_after]
    width = at_a_time or min(max(spark.sparkContext.defaultParallelism, 1), MOST_AT_A_TIME)
    with ThreadPoolExecutor(width) as pool:
        jobs = [pool.submit(score, batch) for batch in todo]
    for job in jobs:
        job.result()
    if len(todo) == len(planned):
        manifest.close(plan)
    return len(todo)


def stream_scoring(spark: SparkSession, input_path: str, schema: T.StructType, scorer: Scorer,
                   out_path: str, checkpoint: str, max_bytes_per_trigger: int = BATCH_BYTES) -> None:
    """Score every input file not yet processed (per the checkpoint) and
    stop when the input is drained."""
    src = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(input_path)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    q = src.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()


def read_scored(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path).drop("batch")
