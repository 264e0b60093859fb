"""Location leakage analysis: A8, A9, T1, F18, V13 and the lookup join J3.

The per-location rate table has one row per location. Everything downstream
(top/bottom lists, extreme counts, the leakage correlation) is computed from
that table alone; no row-level join is needed for the correlation because
corr(rate_of_row, label) only needs per-location sums:
    sum(y) = sum_l s_l, sum(y^2) = sum_l s_l, sum(r) = sum_l n_l r_l,
    sum(r^2) = sum_l n_l r_l^2, sum(r*y) = sum_l r_l s_l   (s_l positives, n_l rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOC = "customer_location"
LABEL = "is_fraudulent"
# Extreme-rate cut-offs and the leakage verdict cut-off.
EXTREME_HIGH = 0.9
EXTREME_LOW = 0.1
LEAK_CORRELATION = 0.5
# Lookup tables of at most this many bytes (measured) are broadcast.
BROADCAST_MAX_BYTES = 64 << 20
# Beyond that, a key with more than 1 / HOT_KEYS of the rows is hot.
HOT_KEYS = 1000


def location_rates(df: DataFrame, loc: str = LOC, label: str = LABEL) -> DataFrame:
    """Mean label and row count per location (null locations dropped)."""
    return (df.where(F.col(loc).isNotNull())
            .groupBy(loc)
            .agg(F.avg(F.col(label).cast("double")).alias("fraud_rate"),
                 F.count(F.lit(1)).alias("n"),
                 F.sum(F.col(label).cast("double")).alias("n_positive")))


def top_locations(rates: DataFrame, n: int = 10, bottom: bool = False, loc: str = LOC) -> DataFrame:
    """Top (or bottom) n locations by rate; ties broken by location name."""
    order = ([F.col("fraud_rate").asc(), F.col(loc).asc()] if bottom
             else [F.col("fraud_rate").desc(), F.col(loc).asc()])
    return rates.orderBy(*order).limit(n).select(loc, "fraud_rate", "n")


def extreme_counts(rates: DataFrame) -> DataFrame:
    """number of locations with rate > 0.9 and rate < 0.1."""
    r = F.col("fraud_rate")
    return rates.agg(F.count_if(r > EXTREME_HIGH).alias("n_extreme_fraud"),
                     F.count_if(r < EXTREME_LOW).alias("n_extreme_legit"))


def leakage_correlation(rates: DataFrame) -> DataFrame:
    """Pearson corr(location rate of the row, label) and the leak verdict.

    Rows whose location is null have no rate and are left out, as in a pandas
    ``corr`` of the mapped column.
    """
    n, s, r = F.col("n").cast("double"), F.col("n_positive"), F.col("fraud_rate")
    sums = rates.agg(F.sum(n).alias("N"), F.sum(s).alias("Sy"),
                     F.sum(n * r).alias("Sr"), F.sum(n * r * r).alias("Srr"),
                     F.sum(r * s).alias("Sry"))
    N, Sy, Sr, Srr, Sry = (F.col(c) for c in ["N", "Sy", "Sr", "Srr", "Sry"])
    cov = Sry - Sr * Sy / N
    var_r = Srr - Sr * Sr / N
    var_y = Sy - Sy * Sy / N
    corr = F.try_divide(cov, F.sqrt(var_r * var_y))
    return sums.select(corr.alias("correlation"),
                       F.coalesce(corr > LEAK_CORRELATION, F.lit(False)).alias("possible_leak"))


def location_report(df: DataFrame, n: int = 10) -> DataFrame:
    """A8 + T1 + F18 + A9 as one long table (kind, location, value)."""
    rates = location_rates(df)
    top = top_locations(rates, n).select(F.lit("top").alias("kind"), F.col(LOC).alias("location"),
                                         F.col("fraud_rate").alias("value"))
    bottom = top_locations(rates, n, bottom=True).select(
        F.lit("bottom").alias("kind"), F.col(LOC).alias("location"),
        F.col("fraud_rate").alias("value"))
    ext = extreme_counts(rates).select(F.inline(F.array(
        F.struct(F.lit("n_extreme_fraud").alias("kind"), F.lit(None).cast("string").alias("location"),
                 F.col("n_extreme_fraud").cast("double").alias("value")),
        F.struct(F.lit("n_extreme_legit").alias("kind"), F.lit(None).cast("string").alias("location"),
                 F.col("n_extreme_legit").cast("double").alias("value")))))
    corr = leakage_correlation(rates).select(F.lit("correlation").alias("kind"),
                                             F.lit(None).cast("string").alias("location"),
                                             F.col("correlation").alias("value"))
    return top.unionByName(bottom).unionByName(ext).unionByName(corr)


def lookup_join(df: DataFrame, table: DataFrame, key: str,
                max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Left lookup join with a table of one row per key.

    The table is broadcast only if its measured size is within
    ``max_broadcast_bytes``. Otherwise the rows of hot keys (fewer than
    HOT_KEYS) take their values from a broadcast of those keys alone and are
    spread over the shuffle join, in which they match nothing.
    """
    rest = [c for c in table.columns if c != key]
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= max_broadcast_bytes:
        return df.join(F.broadcast(table), key, "left")
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > total // HOT_KEYS).select(key)
    near = F.broadcast(table.join(F.broadcast(hot), key, "left_semi").select(key, F.struct(*rest).alias("_hot")))
    far = table.select(key, F.struct(*rest).alias("_cold"), F.pmod(F.xxhash64(key), F.lit(1)).alias("_route"))
    # (zero, but no literal, which would be folded out of the join keys); hot keys and the null key are spread by a hash of the whole row
    away = F.col("_hot").isNotNull() | F.col(key).isNull()
    route = F.when(away, F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)) + 1).otherwise(F.lit(0).cast("bigint"))
    out = df.join(near, key, "left").withColumn("_route", route).join(far, [key, "_route"], "left")
    value = F.coalesce("_hot", "_cold")
    return out.select(*df.columns, *[value[c].alias(c) for c in rest])
