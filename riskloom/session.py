"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every riskloom job expects. Zone-less source timestamps are read as
# TIMESTAMP_NTZ, so results do not depend on the session zone; UTC is pinned
# anyway so that printed timestamps are stable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "riskloom",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and written tables.

    Order: the session's ``spark.checkpoint.dir``; else a folder already set on
    the context by ``setCheckpointDir``; else, only on a local master (tests), a
    private scratch folder. On any other master a missing folder is an error:
    a machine-local one would not be seen by the other executors.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if not path:
        if current:
            return current
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not current or not current.rstrip("/").rpartition("/")[0].endswith(path.rstrip("/").split(":")[-1]):
        sc.setCheckpointDir(path)
    return path


_RUN: ContextVar[str | None] = ContextVar("run folder", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location for written tables under the shared checkpoint folder, or in the current run's folder there."""
    return os.path.join(ensure_checkpoint_dir(spark), *filter(None, [_RUN.get()]), name)


@contextmanager
def run_folder(spark: SparkSession):
    """Tables written inside the block go to one folder of its own, which is deleted at its end.

    Results must be written elsewhere (or collected) inside the block. After an
    error the folder stays, for a look at what was written.
    """
    token = _RUN.set(f"run-{uuid.uuid4().hex}")
    try:
        path = scratch_path(spark, "")
        yield path
        drop_path(spark, path)
    finally:
        _RUN.reset(token)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """The shuffle files of a query that runs inside the block (a write, whose result stays elsewhere) go when it ends, not when the driver collects its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def rows_of_blocks(spark: SparkSession, rows: int = 2):
    """Rows that hold a packed block each reach the Python tasks a few at a time inside the block: a task works on some while Spark reads the next, and no batch grows with the partition."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared checkpoint folder, in whatever file system it is."""
    if not path.startswith(ensure_checkpoint_dir(spark)):
        raise ValueError(f"{path} is not under the checkpoint folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
