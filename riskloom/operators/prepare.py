"""Preparation: F19 column selection, E1 imputation, E2 label encoding,
E3 one-hot encoding, E4 target encoding.

All fitted state is small: a dict of fill values (one per column), the level
lists of low-cardinality columns, and the per-location rate table (broadcast
only behind a row-count check).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import HOUR_BINS, AGE_BINS, SIZE_BINS
from .location import location_rates, lookup_join
from .profile import median_mode
from ..session import ensure_checkpoint_dir

LABEL = "is_fraudulent"
ID = "transaction_id"

# The model's feature list, in the reference's order.
MODEL_FEATURES = [
    "transaction_amount", "quantity", "customer_age", "account_age_days", "transaction_hour",
    "total_customer_transactions", "address_mismatch", "day_of_week", "month", "is_weekend",
    "new_account", "transaction_amount_ratio",
    "avg_daily_transaction_velocity", "time_since_last_transaction",
    "amount_deviation_from_history", "product_category_diversity",
    "amount_log", "amount_per_quantity", "amount_zscore",
    "hour_bin", "age_category", "account_age_weeks", "transaction_size", "quantity_log",
    "high_amount_flag", "high_quantity_flag", "unusual_hour_flag",
    "amount_age_interaction", "amount_velocity_interaction",
    "new_account_high_value", "weekend_high_value", "high_risk_profile",
    "velocity_deviation", "suspicious_pattern",
    "payment_method", "product_category", "device_used", "customer_location",
]
ONE_HOT_COLUMNS = ["payment_method", "product_category", "device_used",
                   "hour_bin", "age_category", "transaction_size"]
STRING_COLUMNS = ["payment_method", "product_category", "device_used", "customer_location"]
# Ordered bins keep their bin order (their first bin is dropped).
ORDERED_LEVELS = {"hour_bin": HOUR_BINS, "age_category": AGE_BINS, "transaction_size": SIZE_BINS}
TARGET_ENCODED = "customer_location"
# Default of the one-hot encoder's max_levels (exact level counts are compared with it).
MAX_ONE_HOT_LEVELS = 1000


def select_features(df: DataFrame, keep=(ID, LABEL, "split")) -> DataFrame:
    """the model's feature columns that are present, plus id, label (and split)."""
    cols = [c for c in keep if c in df.columns] + [c for c in MODEL_FEATURES if c in df.columns]
    return df.select(*cols)


def numeric_columns(df: DataFrame, exclude=(ID, LABEL, "split")):
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def imputable_strings(df: DataFrame):
    return [c for c in STRING_COLUMNS if c in df.columns]


def fit_imputer(df: DataFrame, approx: bool = False, every_column: bool = False) -> dict:
    """A10 -> fill values: median per numeric column, mode per string column.

    Where the rows to fill are the fitting rows, only columns that contain
    nulls need a value, so a cheap null-count pass runs first and the exact
    medians/modes (the costly part) are computed for those columns only.
    ``every_column`` fits all of them: other rows may have nulls anywhere.
    """
    num, cat = numeric_columns(df), imputable_strings(df)
    if not num and not cat:
        return {}
    if every_column:
        nulls = dict.fromkeys(num + cat, 1)
    else:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in num + cat]).first()
    num = [c for c in num if nulls[c] > 0]
    cat = [c for c in cat if nulls[c] > 0]
    if not num and not cat:
        return {}
    rows = median_mode(df, num, cat, approx=approx).collect()
    fill = {}
    for r in rows:
        v = r["median"] if r["column_name"] in num else r["mode"]
        if v is not None:
            fill[r["column_name"]] = v
    return fill


def impute(df: DataFrame, fill: dict) -> DataFrame:
    """Numeric features become double, then nulls take the fitted values.

    Binned categories are not filled (the reference's mode imputation skips
    them); a null bin later becomes an all-zero one-hot row.
    """
    num = numeric_columns(df)
    out = df.withColumns({c: F.col(c).cast("double") for c in num})
    return out.na.fill({k: v for k, v in fill.items() if k in out.columns})


def fit_one_hot(df: DataFrame, columns=None, max_levels: int = MAX_ONE_HOT_LEVELS) -> dict:
    """E3 fit: kept levels per column (first level dropped).

    Strings: sorted distinct levels. A column with more than ``max_levels``
    levels (counted exactly) is refused. Ordered bins: their fixed bin order.
    """
    columns = [c for c in (columns or ONE_HOT_COLUMNS) if c in df.columns]
    strings = [c for c in columns if c not in ORDERED_LEVELS]
    levels = {}
    if strings:
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                          for c in strings])
        # one row for each column and level; the counts are read before any level list
        distinct = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct().persist()
        for r in distinct.groupBy("c").count().collect():
            if r["count"] > max_levels:
                distinct.unpersist()
                raise ValueError(f"{r['c']} has {r['count']} levels, more than max_levels = {max_levels}; "
                                 "use target encoding instead")
        for r in distinct.collect():
            levels.setdefault(r["c"], []).append(r["v"])
        distinct.unpersist()
        levels = {c: sorted(v) for c, v in levels.items()}
    for c in columns:
        if c in ORDERED_LEVELS:
            levels[c] = list(ORDERED_LEVELS[c])
        levels.setdefault(c, [])
    return {c: lv[1:] for c, lv in levels.items()}


def dummy_name(column: str, level: str) -> str:
    return f"{column}_{re.sub(r'[^0-9a-zA-Z]+', '_', level).strip('_').lower()}"


def dummy_names(kept: dict, taken=()) -> dict:
    """(column, level) -> output name; names that would collide get _2, _3, ... in level order."""
    used, names = {t.lower() for t in taken}, {}
    for c, lv in kept.items():
        for level in lv:
            name = base = dummy_name(c, level)
            n = 1
            while name.lower() in used:
                n += 1
                name = f"{base}_{n}"
            used.add(name.lower())
            names[c, level] = name
    return names


def one_hot(df: DataFrame, kept: dict) -> DataFrame:
    """E3 apply: one 0/1 int column per kept level; null -> all zeros."""
    names = dummy_names(kept, [c for c in df.columns if c not in kept])
    new = {name: F.coalesce((F.col(c) == level).cast("int"), F.lit(0)) for (c, level), name in names.items()}
    return df.withColumns(new).drop(*kept.keys())


def fit_label_encoder(df: DataFrame, columns=None) -> DataFrame:
    """E2 fit: (column_name, level, level_index), the sorted-level index of every level of each string column.

    The distinct levels are range-partitioned by (column, level) and kept so; a
    level's index is its place in its range plus the levels of the column's
    earlier ranges. No task and no driver holds a column's levels.
    """
    columns = [c for c in (columns or STRING_COLUMNS) if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns])
    ensure_checkpoint_dir(df.sparkSession)
    levels = (df.select(F.inline(pairs)).where("level IS NOT NULL").distinct()
              .repartitionByRange("column_name", "level").withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    before = Window.partitionBy("column_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each column and partition
    offsets = (levels.groupBy("column_name", "_part").count()
               .select("column_name", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")))
    place = F.row_number().over(Window.partitionBy("column_name", "_part").orderBy("level")) - 1
    return (levels.withColumn("_place", place).join(F.broadcast(offsets), ["column_name", "_part"])
            .select("column_name", "level", (F.col("_offset") + F.col("_place")).cast("double").alias("level_index")))


def label_encode(df: DataFrame, levels: DataFrame) -> DataFrame:
    """E2 apply: <column>_index; a null or unknown level takes the number of levels."""
    sizes = {r["column_name"]: r["count"] for r in levels.groupBy("column_name").count().collect()}  # a row for each column
    for c, n in sorted(sizes.items()):
        table = levels.where(F.col("column_name") == c).select(F.col("level").alias(c), F.col("level_index").alias(f"{c}_index"))
        df = lookup_join(df, table, c).fillna(float(n), [f"{c}_index"])
    return df


def fit_target_encoder(df: DataFrame, label: str = LABEL, column: str = TARGET_ENCODED):
    """E4 fit: (rates table, prior). Rates are A8 on the fitting rows."""
    rates = location_rates(df, column, label).select(column, F.col("fraud_rate").alias("_rate"))
    prior = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return rates, prior


def target_encode(df: DataFrame, rates: DataFrame, prior: float | None,
                  column: str = TARGET_ENCODED) -> DataFrame:
    """E4 apply: replace the location by its rate; unseen locations take the prior."""
    j = lookup_join(df, rates, column)
    rate = F.col("_rate") if prior is None else F.coalesce(F.col("_rate"), F.lit(float(prior)))
    return j.withColumn(column, rate).drop("_rate")


def prepare(features: DataFrame, fit_rows: DataFrame | None = None,
            label: str = LABEL, approx_median: bool = False) -> DataFrame:
    """F19 -> E1 -> E3 -> E4 on the feature table.

    ``fit_rows`` (default: all rows, the reference's behaviour) supplies the
    imputation values, level lists and location rates; pass the training split
    for leak-free preparation.
    """
    x = select_features(features)
    fit_x = x if fit_rows is None else select_features(fit_rows)
    fill = fit_imputer(fit_x, approx=approx_median, every_column=fit_rows is not None)
    x = impute(x, fill)
    fit_imp = impute(fit_x, fill)
    kept = fit_one_hot(fit_imp)
    x = one_hot(x, kept)
    if TARGET_ENCODED in x.columns:
        rates, prior = fit_target_encoder(
            features if fit_rows is None else fit_rows, label)
        x = target_encode(x, rates, None if fit_rows is None else prior)
    return x


def design_columns(prepared: DataFrame):
    """Names of the model inputs of a prepared table (all but id and label)."""
    return [c for c in prepared.columns if c not in (ID, LABEL, "split")]
