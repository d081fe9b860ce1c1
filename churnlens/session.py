"""SparkSession construction with settings that hold from local[8] to a cluster."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "churnlens") -> SparkSession:
    """Create (or reuse) a session.

    On a cluster the launcher supplies master, shuffle partitions and the shared
    checkpoint folder; we only fill in values that are unset, so a test run on
    ``local[*]`` gets small-data defaults while cluster settings win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # parquet timestamps of the inputs are zone-less; keep them that way
        "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    }
    if SparkSession.getActiveSession() is None and not os.environ.get("PYSPARK_SUBMIT_ARGS"):
        # local runs only: a launcher-provided session keeps its own sizing
        conf.setdefault("spark.driver.memory", os.environ.get("CHURNLENS_DRIVER_MEMORY", "8g"))
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only a local master may go without one (a test run): it gets a private
    scratch folder. On a cluster a machine's own folder would lose data, so a
    session without ``spark.checkpoint.dir`` is refused there.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all machines of {master} share")
        current = tempfile.mkdtemp(prefix="churnlens-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


#: bytes that a task reads where a byte of a small row costs far more than one of a long text
SMALL_TASK = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "16m"}


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile get tasks of SMALL_TASK bytes, so that a few tasks full of small rows don't outlast the
    others; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SMALL_TASK}
    try:
        for k, v in SMALL_TASK.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
