"""Sessions and lineage cuts shared by every iterative plan."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "kindred") -> SparkSession:
    """The session that is there, or the one that spark-submit describes; a local one where no master is named."""
    there = SparkSession.getActiveSession()
    if there:
        return there
    named = "spark.master" in dict(SparkConf().getAll())
    return SparkSession.builder.appName(app).getOrCreate() if named else local_session(app=app)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kindred") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KINDRED_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset and the master local a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back: replicated files, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int, rows_per_task: int = 100_000) -> DataFrame:
    """`df`, which has so many rows, in as few partitions as they need."""
    return df.coalesce(max(1, -(-rows // rows_per_task)))


def settle(df: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """`cut`, read back by as few tasks as its rows need: later shuffles of a small table then write few files."""
    out = cut(df)
    return few(out, out.count(), rows_per_task)
