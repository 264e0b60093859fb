"""The reference's end-to-end flow as Spark jobs.

load -> features -> split -> prepare -> scale -> variance filter -> rebalance
-> four class-weighted models -> thresholds on validation -> blend ->
evaluation on test -> explanations.

The driver only holds scalars, level lists, per-feature statistics and fitted
models; every row-level step is a distributed DataFrame operation. The
transactions and the feature table are persisted while the fits read them; the design matrix is
checkpointed to the shared checkpoint folder (a lineage cut) because all model
fits read it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import prepare as prep
from ..operators import split as splt
from ..operators import weights as wts
from ..operators import balance as bal
from ..operators import models as mdl
from ..operators import network as net
from ..operators import many_models as mm
from ..operators import threshold as thr
from ..operators import ensemble as ens
from ..operators import evaluate as ev
from ..operators import explain as xp
from ..operators import tree_shapley as tshap
from ..session import ensure_checkpoint_dir

ID, LABEL = "transaction_id", "is_fraudulent"


@dataclass
class DesignMatrix:
    df: DataFrame                      # row_id, label, split, features_arr, features
    names: list                        # model inputs, after the variance filter
    all_names: list = field(default_factory=list)


def build_design(txn: DataFrame, fit: str = "train", seed: int = splt.SEED,
                 variance_threshold: float = 0.01, materialize: str = "checkpoint",
                 approx: bool = False, variance_stage: str = "scaled",
                 history: str | None = None) -> DesignMatrix:
    """Features -> split -> prepare -> scale -> variance filter -> vectors.

    ``fit='train'`` (default) fits statistics, imputation values and location
    rates on the training split only; ``fit='all'`` reproduces the reference,
    which fits them on all rows before splitting (a label leak). ``materialize='checkpoint'`` writes the design matrix to the
    shared ``spark.checkpoint.dir`` (a lineage cut: model fits that run for a
    long time reread it instead of recomputing the feature pipeline after an
    executor loss); ``'persist'`` keeps it in executor memory/disk only.
    ``approx=True`` uses sketch quantiles for A1 and the imputation medians
    (for columns whose distinct values are unbounded at large scale).
    ``variance_stage='scaled'`` filters on the standardised training rows as
    the reference does (after scaling only constants fall below 0.01);
    ``'raw'`` filters on the unscaled training variances instead.
    ``history``: 'past' gives customer aggregates as of each row (no future
    rows), 'all' the reference's full-history aggregates; by default 'past'
    with ``fit='train'`` and 'all' with ``fit='all'``.
    """
    if history is None:
        history = "past" if fit == "train" else "all"
    # the split, the statistics and the features all read the transactions: their joins run once
    cached = txn.storageLevel.useMemory or txn.storageLevel.useDisk
    txn = txn if cached else txn.persist(StorageLevel.MEMORY_AND_DISK)
    txn_s = splt.stratified_split(txn, LABEL, ID, seed)
    train_rows = txn_s.where(F.col("split") == "train")
    stats = feat.fit_global_stats(train_rows if fit == "train" else txn_s, approx=approx)
    # with all-row statistics the row count bounds every customer's count
    has_hot = False if (fit != "train" and stats.n_rows is not None
                        and stats.n_rows <= feat.DEFAULT_CHUNK_ROWS) else None
    feats = feat.feature_table(txn_s, stats, has_hot=has_hot,
                               history=history).persist(StorageLevel.MEMORY_AND_DISK)
    fit_rows = feats.where(F.col("split") == "train") if fit == "train" else None
    prepared = prep.prepare(feats, fit_rows=fit_rows, approx_median=approx)
    cols = prep.design_columns(prepared)
    train_p = prepared.where(F.col("split") == "train")
    scaler = splt.fit_scaler(train_p, cols)
    scaled = splt.standardize(prepared, scaler)
    # D3 from the same moments: var / scale^2 (scaled) or var itself (raw)
    kept = splt.variance_filter_from_scaler(scaler, cols, variance_threshold,
                                            stage=variance_stage)
    dm = (scaled.select(F.col(ID).alias("row_id"), F.col(LABEL).cast("double").alias("label"),
                        "split", F.array(*[F.col(c) for c in kept]).alias("features_arr"))
          .transform(lambda d: mdl.from_array(d, "features_arr")))
    if materialize == "checkpoint":
        ensure_checkpoint_dir(dm.sparkSession)
        dm = dm.checkpoint(eager=True)
        feats.unpersist()
        if not cached:
            txn.unpersist()
    else:
        dm = dm.persist(StorageLevel.MEMORY_AND_DISK)
    return DesignMatrix(dm, kept, cols)


def rebalance(train: DataFrame, strategy: str = "adasyn", seed: int = splt.SEED) -> DataFrame:
    """B1/B2/B3 on the training rows (row_id, label, features_arr)."""
    t = train.select("row_id", "label", "features_arr")
    if strategy == "smote":
        out = bal.smote(t, "row_id", "features_arr", "label", seed=seed)
    elif strategy == "hybrid":
        out = bal.hybrid(t, "row_id", "features_arr", "label", seed=seed)
    elif strategy == "none":
        out = t.withColumn("synthetic", F.lit(0))
    else:
        out = bal.adasyn(t, "row_id", "features_arr", "label", seed=seed)
    return mdl.from_array(out, "features_arr")


# The mode (class weights) each model has by default: recall 1:50, precision 1:10.
MODES = {"lr": "recall", "rf": "recall", "gbt": "precision"}


def train_model(name: str, balanced: DataFrame, n_features: int, mode: str | None = None, **params):
    """One of L1-L4. ``mode`` ('recall' or 'precision') sets the class weights
    of lr, rf and gbt. nn takes the rebalanced rows without a mode; with one it
    is the focal-loss network, which needs ``validation`` rows and takes the
    mode's class weights and loss. ``params`` go to the trainer, whose defaults
    are the full-size model."""
    if name == "nn":
        if mode is None:
            return mdl.neural_network(balanced, n_features, **params)
        rows = [wts.class_weights(d, mode, label="label") for d in (balanced, params.pop("validation"))]
        return net.focal_network(*rows, n_features, mode=mode, **params)
    trainers = {"lr": mdl.logistic_regression, "rf": mdl.random_forest, "gbt": mdl.boosted_trees}
    if name not in trainers:
        raise ValueError(name)
    if name == "lr":
        params = {"C": 0.01, "penalty": "l1", **params}
    return trainers[name](wts.class_weights(balanced, mode or MODES[name], label="label"), **params)


def train_models(balanced: DataFrame, n_features: int, params: dict | None = None, modes: dict | None = None) -> dict:
    """L1-L4; ``params`` and ``modes`` by model name."""
    return {n: train_model(n, balanced, n_features, (modes or {}).get(n), **(params or {}).get(n, {}))
            for n in ("lr", "rf", "nn", "gbt")}


def score_all(models: dict, df: DataFrame) -> DataFrame:
    out = None
    for name, m in models.items():
        s = mdl.score(m, df, name)
        out = s if out is None else out.unionByName(s)
    return out


def run(txn: DataFrame, fit: str = "train", strategy: str = "adasyn", params: dict | None = None,
        modes: dict | None = None) -> dict:
    """Entry 1: the whole flow; returns the result tables.

    The rebalanced rows and the base scores are checkpointed: every trainer and
    every evaluation table reads them again.
    """
    dm = build_design(txn, fit=fit)
    d = dm.df
    train, val, test = (d.where(F.col("split") == s) for s in ("train", "val", "test"))
    balanced = rebalance(train, strategy).checkpoint(eager=True)
    models = train_models(balanced, len(dm.names), params, modes)
    base_val, base_test = (score_all(models, rows).checkpoint(eager=True) for rows in (val, test))
    names = list(models)
    val_s = base_val.unionByName(ens.blend_long(base_val, models=names))
    test_s = base_test.unionByName(ens.blend_long(base_test, models=names))
    thresholds = thr.profile_thresholds(val_s)
    pred = ev.predict(test_s, thresholds)
    thr_of = ev.threshold_map(thresholds)
    metrics = ev.metric_table(pred, ev.auc_table(test_s))
    shap = xp.linear_shapley(models["lr"], test, dm.names, train)
    ensemble = ens.EnsembleModel(models, thr_of.get("ensemble", ens.STAGE1_CUT))
    return {
        "design": dm, "models": models, "thresholds": thresholds, "scores": test_s,
        "pred": pred, "metrics": metrics, "confusion": ev.confusion_matrix(pred),
        "report": ev.classification_report(pred), "stage_counts": ens.stage_counts(base_val, thresholds),
        "rf_importance": xp.tree_importances(models["rf"], dm.names),
        "shap": shap, "mean_abs_shap": xp.mean_abs_attribution(shap),
        "ensemble": ensemble, "shap_by_model": {
            "lr": shap, "rf": tshap.tree_shapley(models["rf"], test, dm.names), "gbt": tshap.tree_shapley(models["gbt"], test, dm.names),
            **{n: xp.sampled_shapley(m, test, dm.names, train) for n, m in (("nn", models["nn"]), ("ensemble", ensemble))}},
    }


# Feature groups for the ablation.
ABLATION_GROUPS = {
    "customer_aggregates": ["total_customer_transactions", "transaction_amount_ratio",
                            "product_category_diversity", "avg_daily_transaction_velocity"],
    "history": ["time_since_last_transaction", "amount_deviation_from_history"],
    "interactions": ["amount_age_interaction", "amount_velocity_interaction",
                     "new_account_high_value", "weekend_high_value", "high_risk_profile",
                     "velocity_deviation", "suspicious_pattern"],
    "risk_flags": ["high_amount_flag", "high_quantity_flag", "unusual_hour_flag",
                   "address_mismatch", "new_account"],
    "location": ["customer_location"],
}


def feature_ablation(dm: DesignMatrix, groups: dict = ABLATION_GROUPS, C: float = 0.01) -> DataFrame:
    """Refit L1 without each feature group; metrics at 0.5 on test.

    All refits are masked columns of one many-model fit, and all their scores
    one table: the training and test rows are read as for one model.
    """
    d = dm.df
    train = wts.class_weights(d.where(F.col("split") == "train"), "recall", label="label")
    sum_w = train.agg(F.sum("weight")).first()[0]
    sets = {g: tuple(i for i, n in enumerate(dm.names) if n not in cols) for g, cols in {"none": [], **groups}.items()}
    blocks = mm.Blocks(train, fold=None)
    try:
        fitted, _ = mm.fit_many(blocks, [mm.Task(1.0 / (C * sum_w), 1.0, None, idx) for idx in sets.values()])
    finally:
        blocks.close()
    models = {g: mdl.LinearScorer(c[:-1], c[-1]) for g, c in zip(sets, fitted)}
    scores = mdl.linear_scores(models, d.where(F.col("split") == "test"))
    pred = ev.predict(scores, {}, default=0.5)
    sizes = F.create_map(*[x for g, idx in sets.items() for x in (F.lit(g), F.lit(len(idx)))])
    return ev.metric_table(pred, ev.auc_table(scores)).select(
        F.col("model").alias("removed_group"), sizes[F.col("model")].alias("n_features"), "accuracy", "precision", "recall", "f1", "auc")
