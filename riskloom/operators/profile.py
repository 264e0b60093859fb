"""Profiling: S2 dataset overview, S3 numeric profile, S4 categorical profile.

Each profile is one aggregate pass (partial aggregation on the map side); the
outputs are small tables whose size depends on the column/level count only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_modes, exact_quantiles

LABEL = "is_fraudulent"
# Columns the reference profiles.
NUMERIC_PROFILE_COLUMNS = ["transaction_amount", "quantity", "customer_age",
                           "account_age_days", "transaction_hour"]
CATEGORICAL_PROFILE_COLUMNS = ["payment_method", "product_category", "device_used"]


def dataset_overview(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows, columns, class counts and positive share (one row)."""
    lab = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.count_if(lab == 1).alias("n_positive"),
        F.count_if(lab == 0).alias("n_negative"),
        (F.avg(lab.cast("double")) * F.lit(100.0)).alias("positive_pct"))


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Value counts of the label."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def numeric_profile(df: DataFrame, columns=None) -> DataFrame:
    """S3: count/mean/std/min/quartiles/max per numeric column (exact quartiles).

    One wide aggregate beside the quartiles' bracketing passes; the single row is
    then turned into one row per column.
    """
    columns = [c for c in (columns or NUMERIC_PROFILE_COLUMNS) if c in df.columns]
    quartiles = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"),
                 F.max(x).alias(f"max{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
        F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
        F.col(f"min{i}").alias("min"),
        *[F.lit(v).cast("double").alias(n) for n, v in zip(("p25", "p50", "p75"), quartiles[c])],
        F.col(f"max{i}").alias("max")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def categorical_profile(df: DataFrame, columns=None) -> DataFrame:
    """Counts per level for each categorical column present; nulls skipped.

    One scan: each row is unpivoted to (column, level) pairs and counted with a
    partially aggregated groupBy, instead of one scan per column.
    """
    columns = [c for c in (columns or CATEGORICAL_PROFILE_COLUMNS) if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.col(c).cast("string").alias("level")) for c in columns])
    return (df.select(F.inline(pairs))
            .where(F.col("level").isNotNull())
            .groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n")))


def median_mode(df: DataFrame, numeric=None, categorical=None, approx: bool = False,
                accuracy: int = 100_000) -> DataFrame:
    """A10: median of each numeric column, mode of each string column.

    Mode ties resolve to the smallest value. Returned long: (column_name,
    median, mode). Medians are exact (``quantiles.exact_quantiles``);
    ``approx=True`` uses ``percentile_approx`` (rank error 1/accuracy) in one pass.
    """
    numeric = [c for c in (numeric or []) if c in df.columns]
    categorical = [c for c in (categorical or []) if c in df.columns]
    if not numeric:
        medians = {}
    elif approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(f"m{i}")
                       for i, c in enumerate(numeric)]).first()
        medians = dict(zip(numeric, row))
    else:
        medians = {c: v[0] for c, v in exact_quantiles(df, {c: F.col(c) for c in numeric}, [0.5]).items()}
    modes = exact_modes(df, categorical)
    rows = [(c, medians[c], None) for c in numeric] + [(c, None, modes[c]) for c in categorical]
    return df.sparkSession.createDataFrame(rows, "column_name string, median double, mode string")


def class_balance(df: DataFrame, label: str = LABEL, by: str | None = "split") -> DataFrame:
    """positives/negatives per split (or overall), ratio and positive %."""
    keys = [by] if by else []
    lab = F.col(label)
    out = df.groupBy(*keys).agg(F.count_if(lab == 1).alias("n_positive"),
                                F.count_if(lab == 0).alias("n_negative"))
    return out.withColumns({
        "minority_ratio": F.try_divide(F.col("n_positive").cast("double"),
                                       F.col("n_negative").cast("double")),
        "positive_pct": F.try_divide(F.col("n_positive") * F.lit(100.0),
                                     (F.col("n_positive") + F.col("n_negative")).cast("double")),
    })
