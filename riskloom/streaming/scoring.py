"""Apply fitted, row-level operators to a stream of transactions.

The reference is batch-only; nothing here adds operators. A stream of
transaction files is read with the same fixed schema as the batch scan (S1),
and each micro-batch -- a static DataFrame -- goes through an existing batch
function (e.g. ``row_features`` + ``stat_features`` with fitted statistics, or
L11 scoring with stored thresholds), then is written to a folder of its own,
``batch_id=N``. Progress is tracked in the checkpoint folder, which must be a
shared location on a cluster; a batch that runs again after a failure overwrites
its own folder, so each row is written once.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.transactions import TEXT_SCHEMA, TXN_SCHEMA, _named, _normalise, from_text


def transaction_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":  # as text, then typed by the batch scan's rule
        return from_text(_named(reader.schema(TEXT_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)))
    return _normalise(reader.schema(TXN_SCHEMA).format(fmt).load(path))


def apply_per_batch(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], sink_path: str,
                    checkpoint: str, once: bool = False):
    """Run ``fn`` on every micro-batch; its result replaces ``sink_path/batch_id=N``."""
    def write(batch: DataFrame, batch_id: int):
        fn(batch).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        w = w.trigger(availableNow=True)
    return w.start()
