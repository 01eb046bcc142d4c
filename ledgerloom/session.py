"""Session helpers shared by every operator: table access, session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Defaults for sessions opened by this package (tests, bench, command line); a cluster's own settings win.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def open_session(name: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``conf``; the defaults above fill what neither it nor the cluster's own configuration sets."""
    builder = SparkSession.builder.appName(name).config(map=conf)
    given = _submitted()
    builder = builder.config(map={k: v for k, v in SESSION_DEFAULTS.items() if k not in conf and k not in given})
    return (builder.master(master) if master else builder).getOrCreate()


def _submitted() -> set[str]:
    """Names of the settings of spark-submit and of the cluster's defaults, or of a session that runs already."""
    from pyspark import SparkConf, SparkContext

    active = SparkSession.getActiveSession()
    if active is not None:
        return {k for k, _ in active.sparkContext.getConf().getAll()}
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return set()
    SparkContext._ensure_initialized()
    return {k for k, _ in SparkConf().getAll()}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder. Only a local session without one gets a temporary folder; a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="ledgerloom-checkpoints-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which survives the loss of executors."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
