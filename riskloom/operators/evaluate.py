"""Evaluation tables: V1 metrics, V2 confusion, V3 classification report,
V4 ROC points + exact AUC, V5 precision-recall points, V6 long metrics,
L10 focal loss, L11 batch scoring, V11 error slices.

Scores are a long table ``(row_id, label, model, proba)``; every table is
computed for all models in one job.

Curves and AUC need, per model, cumulative label counts in score order. A
window over all distinct scores of a model would run in one task, so the
cumulative counts are built in two levels: scores are cut into ranges by
approximate quantiles (about 200,000 distinct scores per range; only the cut
points are approximate and they are fixed for the job), per-range totals (one
row for each model and range) give each range's offset, and rows are
accumulated inside their (model, range) only. The result is exact. A row
without a score (null or NaN) takes no part in curves and AUC.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_RANGES = 16_384        # offsets of more ranges go through a shuffle join
DISTINCT_PER_RANGE = 200_000     # target distinct scores accumulated by one task

LEGIT, FRAUD = "Legitimate", "Fraudulent"


def _dbl(c):
    return F.col(c).cast("double")


def score_counts(scores: DataFrame, group_cols=("model",), n_ranges: int | None = None, with_below: bool = False) -> DataFrame:
    """Per (model, distinct score): pos, neg, counts at or below the score, totals.

    ``with_below`` adds (pos, neg) of the next lower score, across range borders (null for the lowest).

    The number of score ranges follows the number of distinct scores
    (about DISTINCT_PER_RANGE per range); the distinct-score table is kept
    while the range edges and offsets are derived from it. Null and NaN scores
    are left out before anything is counted.
    """
    import math
    g = list(group_cols)
    lab = F.col("label")
    d = (scores.where(F.col("proba").isNotNull() & ~F.isnan("proba")).groupBy(*g, "proba")
         .agg(F.count_if(lab == 1).alias("pos"), F.count_if(lab == 0).alias("neg"))).persist()
    if n_ranges is None:
        n_ranges = max(1, math.ceil(d.count() / DISTINCT_PER_RANGE))
    edges = []
    if n_ranges > 1:
        probs = [i / n_ranges for i in range(1, n_ranges)]
        edges = d.agg(F.percentile_approx("proba", probs, 10 * n_ranges)).first()[0] or []
    splits = [float("-inf")] + sorted({float(e) for e in edges if e is not None}) + [float("inf")]
    if len(splits) > 2:
        d = Bucketizer(splits=splits, inputCol="proba", outputCol="_r",
                       handleInvalid="keep").transform(d)
    else:
        d = d.withColumn("_r", F.lit(0.0))
    per_range = d.groupBy(*g, "_r").agg(F.sum("pos").alias("_rp"), F.sum("neg").alias("_rn"),
                                        F.max_by(F.struct("pos", "neg"), "proba").alias("_last"))
    w_r = Window.partitionBy(*g).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*g)
    offsets = per_range.select(
        *g, "_r",
        F.coalesce(F.sum("_rp").over(w_r), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_rn").over(w_r), F.lit(0)).alias("_on"),
        F.sum("_rp").over(w_all).alias("P"), F.sum("_rn").over(w_all).alias("N"),
        F.lag("_last").over(Window.partitionBy(*g).orderBy("_r")).alias("_before"))
    w_in = Window.partitionBy(*g, "_r").orderBy("proba").rowsBetween(Window.unboundedPreceding, 0)
    side = F.broadcast(offsets) if n_ranges <= BROADCAST_RANGES else offsets
    out = (d.join(side, [*g, "_r"])
           .withColumn("cum_pos", F.col("_op") + F.sum("pos").over(w_in))
           .withColumn("cum_neg", F.col("_on") + F.sum("neg").over(w_in)))
    if with_below:
        own = F.lag(F.struct("pos", "neg")).over(Window.partitionBy(*g, "_r").orderBy("proba"))
        out = out.withColumn("below", F.coalesce(own, "_before"))
    return out.drop("_r", "_op", "_on", "_before")


def auc_table(scores: DataFrame, group_cols=("model",), counts: DataFrame | None = None) -> DataFrame:
    """Exact ROC AUC per model; tied scores get half credit."""
    g = list(group_cols)
    c = counts if counts is not None else score_counts(scores, g)
    neg_below = F.col("cum_neg") - F.col("neg")
    term = (F.col("pos").cast("decimal(38,0)")
            * (F.lit(2) * neg_below + F.col("neg")).cast("decimal(38,0)"))
    agg = c.groupBy(*g).agg(F.sum(term).alias("_s"), F.first("P").alias("P"),
                            F.first("N").alias("N"))
    den = F.lit(2.0) * _dbl("P") * _dbl("N")
    return agg.select(*g, F.when(den > 0, _dbl("_s") / den).alias("auc"))


def roc_points(scores: DataFrame, group_cols=("model",), counts: DataFrame | None = None, drop_intermediate: bool = False,
               n_ranges: int | None = None) -> DataFrame:
    """V4: (threshold, fpr, tpr) at every distinct score, plus the origin.

    ``drop_intermediate`` leaves out a point whose step up the curve has as many
    positives and negatives as the step to the next lower score: it lies on the
    line between its neighbours (the plotting library's rule). The highest and
    lowest scores stay. ``counts``, if given, must then have ``below``.
    """
    g = list(group_cols)
    c = counts if counts is not None else score_counts(scores, g, n_ranges, with_below=drop_intermediate)
    if drop_intermediate:
        top = (F.col("cum_pos") == F.col("P")) & (F.col("cum_neg") == F.col("N"))
        c = c.where(top | F.col("below").isNull() | (F.col("below.pos") != F.col("pos")) | (F.col("below.neg") != F.col("neg")))
    tp = F.col("P") - F.col("cum_pos") + F.col("pos")
    fp = F.col("N") - F.col("cum_neg") + F.col("neg")
    pts = c.select(*g, F.col("proba").alias("threshold"),
                   F.try_divide(fp.cast("double"), _dbl("N")).alias("fpr"),
                   F.try_divide(tp.cast("double"), _dbl("P")).alias("tpr"))
    origin = c.select(*g).distinct().select(*g, F.lit(None).cast("double").alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_points(scores: DataFrame, group_cols=("model",), counts: DataFrame | None = None) -> DataFrame:
    """V5: (threshold, precision, recall) at every distinct score, plus (recall 0, precision 1)."""
    g = list(group_cols)
    c = counts if counts is not None else score_counts(scores, g)
    tp = (F.col("P") - F.col("cum_pos") + F.col("pos")).cast("double")
    fp = (F.col("N") - F.col("cum_neg") + F.col("neg")).cast("double")
    pts = c.select(*g, F.col("proba").alias("threshold"),
                   F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
                   F.when(_dbl("P") > 0, tp / _dbl("P")).otherwise(F.lit(1.0)).alias("recall"))
    end = c.select(*g).distinct().select(*g, F.lit(None).cast("double").alias("threshold"),
                                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def threshold_map(thresholds) -> dict:
    """Stored thresholds as {model: threshold} (one row per model)."""
    if isinstance(thresholds, dict):
        return dict(thresholds)
    return {r["model"]: float(r["threshold"])
            for r in thresholds.select("model", "threshold").collect()}


def predict(scores: DataFrame, thresholds, default: float = 0.5) -> DataFrame:
    """``pred = proba >= threshold`` with each model's stored threshold,
    else the default. The thresholds (one scalar per model) are fitted state,
    applied as a literal map: a projection, no join."""
    tm = threshold_map(thresholds)
    if tm:
        lookup = F.create_map(*[x for m, t in tm.items() for x in (F.lit(m), F.lit(t))])
        thr_col = F.coalesce(lookup[F.col("model")], F.lit(default))
    else:
        thr_col = F.lit(default)
    out = scores.withColumn("threshold", thr_col.cast("double"))
    return out.withColumn("pred", (F.col("proba") >= F.col("threshold")).cast("int"))


def confusion_counts(pred: DataFrame, group_cols=("model",)) -> DataFrame:
    g = list(group_cols)
    lab, p = F.col("label"), F.col("pred")
    return pred.groupBy(*g).agg(
        F.count_if((lab == 1) & (p == 1)).alias("tp"), F.count_if((lab == 0) & (p == 1)).alias("fp"),
        F.count_if((lab == 1) & (p == 0)).alias("fn"), F.count_if((lab == 0) & (p == 0)).alias("tn"))


def _ratio(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def metric_table(pred: DataFrame, auc: DataFrame | None = None, group_cols=("model",)) -> DataFrame:
    """V1: accuracy, precision, recall, F1, F2 (and AUC) per model."""
    g = list(group_cols)
    cc = confusion_counts(pred, g)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = cc.select(*g, _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
                    _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
                    _ratio(F.lit(5) * tp, F.lit(5) * tp + F.lit(4) * fn + fp).alias("f2"))
    if auc is not None:
        out = out.join(auc, g, "left")
    return out


def confusion_matrix(pred: DataFrame, group_cols=("model",)) -> DataFrame:
    """V2: 2 x 2 counts per model, empty cells as 0 (4-row grid per model)."""
    g = list(group_cols)
    counts = pred.groupBy(*g, "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"))
                      for a in (0, 1) for b in (0, 1)])
    grid = pred.select(*g).distinct().select(*g, F.inline(cells))
    return grid.join(counts, [*g, "label", "pred"], "left").na.fill(0, ["n"])


def classification_report(pred: DataFrame, group_cols=("model",)) -> DataFrame:
    """V3: per-class precision/recall/F1/support, accuracy, macro and weighted avg."""
    g = list(group_cols)
    cc = confusion_counts(pred, g)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1_1 = _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn)
    f1_0 = _ratio(F.lit(2) * tn, F.lit(2) * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    wavg = lambda a, b: F.when(n > 0, (a * s0.cast("double") + b * s1.cast("double")) / n.cast("double")) \
        .otherwise(F.lit(0.0))
    rows = F.array(
        F.struct(F.lit(LEGIT).alias("row_name"), p0.alias("precision"), r0.alias("recall"),
                 f1_0.alias("f1_score"), s0.alias("support")),
        F.struct(F.lit(FRAUD).alias("row_name"), p1.alias("precision"), r1.alias("recall"),
                 f1_1.alias("f1_score"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), _ratio(tp + tn, n).alias("f1_score"),
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("row_name"), ((p0 + p1) / F.lit(2.0)).alias("precision"),
                 ((r0 + r1) / F.lit(2.0)).alias("recall"), ((f1_0 + f1_1) / F.lit(2.0)).alias("f1_score"),
                 n.alias("support")),
        F.struct(F.lit("weighted avg").alias("row_name"), wavg(p0, p1).alias("precision"),
                 wavg(r0, r1).alias("recall"), wavg(f1_0, f1_1).alias("f1_score"), n.alias("support")))
    return cc.select(*g, F.inline(rows))


METRICS = ["accuracy", "precision", "recall", "f1", "f2", "auc"]


def metric_comparison(metrics: DataFrame, group_cols=("model",)) -> DataFrame:
    """V6: V1 in long form (model, metric, value)."""
    g = list(group_cols)
    present = [m for m in METRICS if m in metrics.columns]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                     for m in present])
    return metrics.select(*g, F.inline(rows))


def focal_loss(scores: DataFrame, alpha: float = 0.25, gamma: float = 2.0,
               group_cols=("model",)) -> DataFrame:
    """Mean focal loss alpha * (1 - pt)^gamma * bce, p clipped to [1e-7, 1 - 1e-7]."""
    g = list(group_cols)
    p = F.least(F.greatest(F.col("proba"), F.lit(1e-7)), F.lit(1.0 - 1e-7))
    y = _dbl("label")
    bce = -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
    x = scores.withColumn("_bce", bce)
    pt = F.exp(-F.col("_bce"))
    term = F.lit(alpha) * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * F.col("_bce")
    return x.groupBy(*g).agg(F.avg(term).alias("focal_loss"))


# Error-slice cut-offs stated in the report; the others are options.
ESTABLISHED_DAYS = 90
LOW_RISK_RATE = 0.03
TYPICAL_HOURS = (9, 21)


def error_slices(pred: DataFrame, features: DataFrame, location_rates: DataFrame,
                 median_amount: float, deviation_cut: float = 1.0,
                 high_risk_rate: float = 0.1, key: str = "row_id",
                 overlapping: bool = False) -> DataFrame:
    """False negatives and false positives assigned to the first matching
    slice (the report's shares sum to 100 %), or with ``overlapping=True`` to
    every matching slice (share = errors in the slice / all errors of the kind).

    ``features`` is the feature table (keyed by transaction_id), joined on the
    errors only; ``location_rates`` is one row per location (broadcast when its
    checked row count allows).
    """
    errs = pred.where(F.col("label") != F.col("pred"))
    f = features.select(
        F.col("transaction_id").alias(key), "account_age_days", "transaction_amount",
        "customer_location", "transaction_hour", "day_of_week", "new_account", "high_amount_flag",
        "address_mismatch", "amount_deviation_from_history", "velocity_deviation",
        "weekend_high_value")
    from .location import lookup_join        # broadcast only after a row-count check
    rates = location_rates.select("customer_location", F.col("fraud_rate").alias("_rate"))
    x = lookup_join(errs.join(f, key, "left"), rates, "customer_location")
    c = F.col
    fn_slice = (F.when(c("account_age_days") > ESTABLISHED_DAYS, "established_account")
                .when(c("transaction_amount") < F.lit(median_amount), "small_amount")
                .when(c("_rate") < LOW_RISK_RATE, "low_risk_location")
                .when(c("transaction_hour").between(*TYPICAL_HOURS) & (c("day_of_week") < 5),
                      "typical_hours")
                .otherwise("other"))
    fp_slice = (F.when((c("new_account") == 1) & (c("high_amount_flag") == 1), "new_account_high_value")
                .when(c("address_mismatch") == 1, "address_mismatch")
                .when((c("amount_deviation_from_history") > deviation_cut)
                      | (c("velocity_deviation") > deviation_cut), "unusual_pattern")
                .when(c("weekend_high_value") == 1, "weekend_high_value")
                .when(c("_rate") > high_risk_rate, "high_risk_location")
                .otherwise("other"))
    kind = F.when(c("label") == 1, "false_negative").otherwise("false_positive")
    x = x.withColumn("error_kind", kind)
    if not overlapping:
        out = (x.withColumn("slice", F.when(c("label") == 1, fn_slice).otherwise(fp_slice))
               .groupBy("model", "error_kind", "slice").agg(F.count(F.lit(1)).alias("n")))
        w = Window.partitionBy("model", "error_kind")
        return out.withColumn("share", c("n").cast("double") / F.sum("n").over(w))
    fn_conds = [("established_account", c("account_age_days") > ESTABLISHED_DAYS),
                ("small_amount", c("transaction_amount") < F.lit(median_amount)),
                ("low_risk_location", c("_rate") < LOW_RISK_RATE),
                ("typical_hours", c("transaction_hour").between(*TYPICAL_HOURS) & (c("day_of_week") < 5))]
    fp_conds = [("new_account_high_value", (c("new_account") == 1) & (c("high_amount_flag") == 1)),
                ("address_mismatch", c("address_mismatch") == 1),
                ("unusual_pattern", (c("amount_deviation_from_history") > deviation_cut)
                 | (c("velocity_deviation") > deviation_cut)),
                ("weekend_high_value", c("weekend_high_value") == 1),
                ("high_risk_location", c("_rate") > high_risk_rate)]

    def names(conds):
        return F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in conds]),
                        lambda v: v.isNotNull())
    x = x.withColumn("_slices", F.when(c("label") == 1, names(fn_conds)).otherwise(names(fp_conds)))
    totals = x.groupBy("model", "error_kind").agg(F.count(F.lit(1)).alias("_total"))
    out = (x.select("model", "error_kind", F.explode("_slices").alias("slice"))
           .groupBy("model", "error_kind", "slice").agg(F.count(F.lit(1)).alias("n")))
    return (out.join(totals, ["model", "error_kind"])
            .withColumn("share", c("n").cast("double") / c("_total").cast("double")).drop("_total"))
