"""L6 threshold search and L7 threshold profiles.

One pass over the scores: each score is assigned to the last grid threshold
that is <= the score, counted per (model, bucket, label) -- at most 94 x 2 rows
per model -- and the confusion counts of every threshold are suffix sums over
that small table. Equal to sweeping the 93 thresholds one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Threshold grid 0.02, 0.03, ..., 0.94 written as (i + 2) / 100.
GRID_START = 2
GRID_SIZE = 93
FALLBACK_THRESHOLD = 0.5

# Optimisation profiles (beta, FP cost, FN cost) and model roles.
PROFILES = {
    "recall": {"beta": 5.0, "cost_fp": 1.0, "cost_fn": 50.0},
    "precision": {"beta": 0.5, "cost_fp": 50.0, "cost_fn": 1.0},
    "ensemble": {"beta": 2.0, "cost_fp": 5.0, "cost_fn": 20.0},
    "default": {"beta": 1.0, "cost_fp": 1.0, "cost_fn": 5.0},
}
MODEL_PROFILE = {"lr": "recall", "rf": "recall", "nn": "precision", "gbt": "precision",
                 "ensemble": "ensemble"}


def grid_threshold(i) -> "F.Column":
    return (F.lit(GRID_START) + i).cast("double") / F.lit(100.0)


def grid_bucket(p: "F.Column") -> "F.Column":
    """Index of the last grid threshold <= p (-1 below the grid)."""
    i0 = F.floor(p * F.lit(100.0)).cast("int") - F.lit(GRID_START)
    i1 = F.when(grid_threshold(i0) > p, i0 - 1).otherwise(i0)
    i2 = F.when(grid_threshold(i1 + 1) <= p, i1 + 1).otherwise(i1)
    return F.greatest(F.least(i2, F.lit(GRID_SIZE - 1)), F.lit(-1))


def threshold_table(scores: DataFrame, group_cols=("model",), label: str = "label",
                    proba: str = "proba", beta: float = 1.0, cost_fp: float = 1.0,
                    cost_fn: float = 5.0, beta_col: str | None = None) -> DataFrame:
    """Confusion counts and metrics of every grid threshold, per group."""
    g = list(group_cols)
    hist = (scores.withColumn("_b", grid_bucket(F.col(proba)))
            .groupBy(*g, "_b")
            .agg(F.count_if(F.col(label) == 1).alias("_pos"),
                 F.count_if(F.col(label) == 0).alias("_neg")))
    extra = [beta_col] if beta_col else []
    totals = hist.groupBy(*g).agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    # Dense grid per group (explode, no join of large inputs): <= 93 rows per group.
    grid = totals.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))))
    dense = grid.join(hist.where(F.col("_b") >= 0), [*g, "_b"], "left").na.fill(0, ["_pos", "_neg"])
    w = Window.partitionBy(*g).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = (dense.withColumn("tp", F.sum("_pos").over(w)).withColumn("fp", F.sum("_neg").over(w))
         .withColumn("threshold", grid_threshold(F.col("_b"))))
    t = t.withColumn("fn", F.col("P") - F.col("tp")).withColumn("tn", F.col("N") - F.col("fp"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    p, r = F.col("precision"), F.col("recall")
    b2 = (F.col(beta_col) * F.col(beta_col)) if beta_col else F.lit(float(beta * beta))
    pos = (p + r) > 0
    t = t.withColumn("f1", F.when(pos, F.lit(2.0) * (p * r) / (p + r)).otherwise(F.lit(0.0)))
    t = t.withColumn("f_beta", F.when(pos, (F.lit(1.0) + b2) * (p * r) / ((b2 * p) + r))
                     .otherwise(F.lit(0.0)))
    t = t.withColumn("total_cost", fp * F.lit(cost_fp) + fn * F.lit(cost_fn))
    return t.select(*g, *[c for c in extra if c not in g], "threshold", "tp", "fp", "fn", "tn",
                    "precision", "recall", "f1", "f_beta", "total_cost")


def best_threshold(table: DataFrame, group_cols=("model",), optimize_for: str = "f_beta") -> DataFrame:
    """Pick the first best threshold per group (lowest threshold on ties).

    f_beta: a threshold must beat 0; if none does, 0.5 is returned with its
    metrics. cost: the lowest total cost.
    """
    g = list(group_cols)
    if optimize_for == "cost":
        order = [F.col("total_cost").asc(), F.col("threshold").asc()]
    else:
        order = [(F.col("f_beta") > 0).desc(), F.col("f_beta").desc(),
                 (F.col("threshold") == F.lit(FALLBACK_THRESHOLD)).desc(),
                 F.col("threshold").asc()]
    w = Window.partitionBy(*g).orderBy(*order)
    return table.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).drop("_rk")


def optimize_threshold(scores: DataFrame, group_cols=("model",), beta: float = 1.0,
                       cost_fp: float = 1.0, cost_fn: float = 5.0,
                       optimize_for: str = "f_beta", **kw) -> DataFrame:
    """Best grid threshold per group."""
    t = threshold_table(scores, group_cols, beta=beta, cost_fp=cost_fp, cost_fn=cost_fn, **kw)
    return best_threshold(t, group_cols, optimize_for)


def profile_thresholds(scores: DataFrame, model_col: str = "model", **kw) -> DataFrame:
    """Best threshold per model with the model's profile (recall/precision/ensemble).

    One pass for all models; the profile's beta is a per-row column.
    """
    beta = None
    for m, prof in MODEL_PROFILE.items():
        b = PROFILES[prof]["beta"]
        cond = F.col(model_col) == m
        beta = F.when(cond, F.lit(b)) if beta is None else beta.when(cond, F.lit(b))
    beta = beta.otherwise(F.lit(PROFILES["default"]["beta"]))
    x = scores.withColumn("beta", beta)
    t = threshold_table(x, (model_col, "beta"), beta_col="beta", **kw)
    c_fp = c_fn = None
    for m, prof in MODEL_PROFILE.items():
        cond = F.col(model_col) == m
        a, b = F.lit(PROFILES[prof]["cost_fp"]), F.lit(PROFILES[prof]["cost_fn"])
        c_fp = F.when(cond, a) if c_fp is None else c_fp.when(cond, a)
        c_fn = F.when(cond, b) if c_fn is None else c_fn.when(cond, b)
    c_fp = c_fp.otherwise(F.lit(PROFILES["default"]["cost_fp"]))
    c_fn = c_fn.otherwise(F.lit(PROFILES["default"]["cost_fn"]))
    t = t.withColumn("total_cost", F.col("fp").cast("double") * c_fp
                     + F.col("fn").cast("double") * c_fn)
    return best_threshold(t, (model_col,))
