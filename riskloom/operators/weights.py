"""B4 random undersampling of the majority class and B5 class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import hash_cuts, hash_key, order_key

LABEL = "is_fraudulent"
ID = "transaction_id"
SEED = 123
# Positive-class weights of the two modes.
RECALL_WEIGHT = 50.0
PRECISION_WEIGHT = 10.0


def undersample(df: DataFrame, ratio: float = 0.5, label: str = LABEL, key: str = ID,
                seed: int = SEED, exact: bool = True) -> DataFrame:
    """Keep all minority rows and int(n_min / ratio) majority rows.

    ``exact`` keeps the first majority rows in (md5(id || seed), id) order -- a
    filter against one cut key found from bucket counts; otherwise a shuffle-free hash threshold keeps each
    majority row with probability n_keep / n_maj.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return df
    minority = min(counts, key=lambda c: counts[c])
    majority = max(counts, key=lambda c: counts[c])
    n_keep = int(counts[minority] / ratio)
    if n_keep > counts[majority]:
        raise ValueError("ratio would need more majority rows than exist")
    is_maj = F.col(label) == F.lit(majority)
    if not exact:
        u = F.conv(F.substring(hash_key(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
        return df.where(~is_maj | (u < F.lit(n_keep / counts[majority])))
    if n_keep == 0:
        return df.where(~is_maj)
    cut = hash_cuts(df.where(is_maj), label, key, seed, {majority: [n_keep]})[(majority, n_keep)]
    return df.where(~is_maj | (order_key(key, seed) <= F.lit(cut)))


def class_weights(df: DataFrame, mode: str = "recall", label: str = LABEL,
                  weight_col: str = "weight") -> DataFrame:
    """Per-row weight column. recall: 1:50, precision: 1:10,
    balanced: n / (2 * n_class)."""
    if mode == "balanced":
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
        n = sum(counts.values())
        w = None
        for c, k in counts.items():
            val = n / (len(counts) * k)
            w = F.when(F.col(label) == c, val) if w is None else w.when(F.col(label) == c, val)
        return df.withColumn(weight_col, w.otherwise(1.0))
    pos = RECALL_WEIGHT if mode == "recall" else PRECISION_WEIGHT
    return df.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(pos)).otherwise(F.lit(1.0)))
