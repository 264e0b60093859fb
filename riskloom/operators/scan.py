"""Prefix scans over ordered parts of keyed rows, without a task that owns a key.

A key of up to ``part_rows`` rows is one part. The rows of larger keys are
range-partitioned by (key, order), so equal order values of one key split like
any others as long as a later order column differs, and the partition number is
their part: within a key, parts follow each other. Windows partitioned by (key,
part) then scan every part by itself. What they need from before is carried
over the parts' borders by small ordered tables of a few rows for each part:
the last rows of the parts before (``halo``) and their totals (``carry``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CHUNK, HALO = "_chunk", "_halo"
# Parts over which the rows without a key are spread.
NULL_CHUNKS = 4096


@dataclass
class Parts:
    """rows: with the part (_chunk) and whether a row only precedes its part (_halo); borders: (key, _chunk) of the split keys."""
    rows: DataFrame
    key: str
    borders: DataFrame | None

    def spread(self, table: DataFrame) -> DataFrame:
        """A table of one row for each key, with a copy for each part of the key."""
        if self.borders is None:
            return table.withColumn(CHUNK, F.lit(0))
        split = table.join(F.broadcast(self.borders), self.key)
        return table.join(F.broadcast(self.borders.select(self.key).distinct()), self.key, "left_anti").withColumn(CHUNK, F.lit(0)).unionByName(split)


def ordered_parts(df: DataFrame, sizes: DataFrame, key: str, order: list[str], halo_columns: list[str], part_rows: int,
                  halo_rows: int, has_large: bool | None = None, null_spread: str | None = None) -> Parts:
    """The rows of df in parts ordered by the ``order`` columns (ascending, nulls last), with up to halo_rows rows from before each part (halo_columns only, _halo = 1).

    ``sizes`` has (key, _n_rows). Keys of more than part_rows rows are at most
    rows / part_rows, and so, times two, are their parts: those tables are
    broadcast, whatever the input. The rows of large keys are checkpointed, so
    that their parts stay as they are in every pass. ``has_large=False`` says
    that no key is that large. Rows without a key are spread by a hash of ``null_spread``.
    """
    spread = F.pmod(F.xxhash64(null_spread), F.lit(NULL_CHUNKS)).cast("int") if null_spread else F.lit(0)
    whole = F.when(F.col(key).isNull(), spread).otherwise(F.lit(0))
    large = None
    if has_large is None or has_large:
        large = sizes.where(F.col(key).isNotNull() & (F.col("_n_rows") > part_rows)).select(key, "_n_rows").persist()
        n_parts = large.agg(F.sum(F.ceil(F.col("_n_rows") / F.lit(part_rows)))).first()[0]
        if not n_parts:
            large.unpersist()
            large = None
    if large is None:
        return Parts(df.withColumn(CHUNK, whole).withColumn(HALO, F.lit(0)), key, None)
    ensure_checkpoint_dir(df.sparkSession)
    rest = df.join(F.broadcast(large.select(key)), key, "left_anti").withColumn(CHUNK, whole)
    split = (df.join(F.broadcast(large.select(key)), key, "left_semi")
             .repartitionByRange(int(n_parts), F.col(key), *_ascending(order))
             .withColumn(CHUNK, F.spark_partition_id()).checkpoint(eager=True))
    large.unpersist()
    rows = rest.unionByName(split).withColumn(HALO, F.lit(0))
    before = halo(split, key, order, halo_columns, halo_rows).withColumn(HALO, F.lit(1))
    borders = split.select(key, CHUNK).distinct()
    return Parts(rows.unionByName(before, allowMissingColumns=True), key, borders)


def halo(parts: DataFrame, key: str, order: list[str], columns: list[str], n: int) -> DataFrame:
    """For each part of a key, the n rows of the key before it, under that part's number."""
    last = Window.partitionBy(key, CHUNK).orderBy(*[F.col(c).desc_nulls_first() for c in order])
    tails = parts.select(key, CHUNK, *columns).withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= n)
    # n rows of each part: small even for the largest key
    along = Window.partitionBy(key).orderBy(CHUNK, F.col("_back").desc())
    seen = tails.withColumn("_prev", F.collect_list(F.struct(*columns)).over(along.rowsBetween(-n, -1)))
    first = seen.withColumn("_first", F.row_number().over(Window.partitionBy(key, CHUNK).orderBy(F.col("_back").desc()))).where("_first = 1")
    return first.select(key, CHUNK, F.inline("_prev"))


def _ascending(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def carry(parts: DataFrame, key: str, totals: dict[str, Column]) -> DataFrame:
    """(key, _chunk, _p_<name> ...): the totals of all parts of the key before each part.

    Names in ``totals``: "max" (merged by max), "cats" (a set, by union), "mean"
    and "m2" (moments of the "n" values, merged pairwise) and any other (by sum).
    """
    chunks = parts.groupBy(key, CHUNK).agg(*[c.alias(f"_c_{n}") for n, c in totals.items()])
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    if "mean" in totals:
        whole = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        chunks = chunks.withColumn("_first_mean", F.first("_c_mean", ignorenulls=True).over(whole))
    out = []
    for name in totals:
        c = F.col(f"_c_{name}")
        if name == "max":
            value = F.max(c).over(before)
        elif name == "cats":
            value = F.array_distinct(F.flatten(F.collect_list(c).over(before)))
        elif name in ("mean", "m2"):
            # part means enter as differences from the first, so large values with a small spread keep their digits
            n, gap = F.col("_c_n").cast("double"), F.coalesce(F.col("_c_mean") - F.col("_first_mean"), F.lit(0.0))
            total, shift = F.sum(n).over(before), F.sum(n * gap).over(before)
            if name == "mean":
                value = F.col("_first_mean") + F.try_divide(shift, total)
            else:
                inside = F.sum(F.coalesce("_c_m2", F.lit(0.0))).over(before)
                value = inside + F.sum(n * gap * gap).over(before) - F.coalesce(F.try_divide(shift * shift, total), F.lit(0.0))
        else:
            value = F.sum(c).over(before)
        out.append(value.alias(f"_p_{name}"))
    return chunks.select(key, CHUNK, *out)
