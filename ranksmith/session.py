"""Session helpers for tests, the bench and command-line use.

Library code never builds a session; it only reads settings from the one it
is handed (for example ``spark.checkpoint.dir`` in :func:`shared_dir`).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ranksmith") -> SparkSession:
    """A local session configured like the production one (AQE, skew join,
    Arrow), with the web UI off."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RANKSMITH_DRIVER_MEM", "8g"))
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` (or the SparkContext's checkpoint dir).
    Where neither is set, a local master (tests, trial runs: driver and
    executors are one process) gets a private folder; any other master is an
    error, since executors could not see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="ranksmith-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a SparkContext: a zip of its
    modules, sent by Spark's file server.  Needed wherever Python code of the
    package runs in tasks."""
    sc = spark.sparkContext
    if getattr(sc, "_ranksmith_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ranksmith-code-"), "ranksmith.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._ranksmith_shipped = True


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/ranksmith-{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: the plan
    starts afresh there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
