"""Written tables in the shared folder, and batches of consecutive ids."""

from __future__ import annotations

import math
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place under the folder that spark.checkpoint.dir names."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_digest(text: Column, bits: int = 128) -> Column:
    """The first bits of the text's SHA-256, as binary (null for null)."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, bits // 8)


#: Stands for a null id: before all other ids.
NULL_ID = -(1 << 63)


def id_batches(df: DataFrame, id_col: str, rows_per_batch: int, name: str) -> tuple[DataFrame, list[float]]:
    """Adds a column that numbers batches of consecutive ids, rising with the id; also the batches' lower ends.

    Cut points are approximate quantiles of the id over all rows; equal ids
    share a batch. Null ids count as the least. One number per batch reaches
    the driver.
    """
    ids = df.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("double").alias("id"))
    rows = ids.count()
    n = max(1, math.ceil(rows / rows_per_batch))
    cuts = ids.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    lower = [-math.inf, *sorted({float(c) for c in cuts})]
    if len(lower) == 1:
        return df.withColumn(name, F.lit(0).cast("long")), lower
    key = f"{name}_id"
    out = df.withColumn(key, F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("double"))
    out = Bucketizer(splits=[*lower, math.inf], inputCol=key, outputCol=name, handleInvalid="keep").transform(out)
    return out.withColumn(name, F.col(name).cast("long")).drop(key), lower


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns but the text), id (null: NULL_ID), text: operators add columns beside these without clashes."""
    rest = [F.col(c) for c in docs.columns if c != text_col]
    return docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))


def unpacked(df: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs again, in order, with the text that df holds."""
    return df.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


#: A key with more than this share of all rows is hot: there are fewer than its inverse.
HOT_SHARE = 1 / 1000
HOT_ROWS = 500


def lookup(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Inner join of rows with a table of one row for each key; the rows of hot keys don't meet in one task.

    counts (key, n) has the rows of each key. The table's rows for hot keys, at
    most 1 / HOT_SHARE of them, are broadcast; rows of those keys are spread by a
    hash of all their columns and of the partition they come from (equal rows
    spread too) over the other join, in which they match nothing.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(HOT_ROWS, int(total * HOT_SHARE))).select(key)
    rest = [c for c in table.columns if c != key]
    value = F.struct(*rest)
    near = F.broadcast(table.join(F.broadcast(hot), key, "left_semi").select(key, value.alias("__hot")))
    far = table.select(key, value.alias("__cold"), F.pmod(F.xxhash64(key), F.lit(1)).alias("__route"))  # zero, but not a literal: those are folded out of join keys
    spread = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(1 << 40)) + 1)
    out = rows.join(near, key, "left").withColumn("__route", spread).join(far, [key, "__route"], "left")
    out = out.withColumn("__value", F.coalesce("__hot", "__cold")).where("__value IS NOT NULL")
    return out.select(*rows.columns, *[F.col("__value")[c].alias(c) for c in rest])
