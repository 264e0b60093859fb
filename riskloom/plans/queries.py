"""Registered Spark queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each reads the driver's tables (through the fixtures) so its work grows with
them. Doubles are rounded to 6 places for the cross-engine comparison.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import round_doubles
from ..sources import sinks
from ..sources.transactions import fixture_gaps, fixture_transactions, read_transactions
from ..sources.scores import fixture_scores
from ..operators import features as feat
from ..operators.quantiles import exact_quantiles

Q: dict = {}


def register(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _txn(spark, sf_dir):
    return fixture_transactions(spark, sf_dir)


@register("S1_transactions")
def q_s1(spark, sf_dir):
    return _txn(spark, sf_dir)


@register("F1_csv_scan")
def q_f1(spark, sf_dir):
    """The transactions written as the source's CSV and scanned from it."""
    return read_transactions(spark, sinks.write_csv(_txn(spark, sf_dir), spark, "transactions"))


@register("F_row_features")
def q_row_features(spark, sf_dir):
    df = feat.row_features(_txn(spark, sf_dir))
    cols = ["transaction_id", "address_mismatch", "day_of_week", "month", "is_weekend",
            "new_account", "amount_log", "amount_per_quantity", "hour_bin", "age_category",
            "account_age_weeks", "quantity_log", "unusual_hour_flag"]
    return round_doubles(df.select(*cols))


@register("A1_global_stats")
def q_a1(spark, sf_dir):
    return round_doubles(feat.global_stats_frame(_txn(spark, sf_dir)))


@register("F_stat_features")
def q_stat_features(spark, sf_dir):
    txn = _txn(spark, sf_dir)
    df = feat.stat_features(txn, feat.fit_global_stats(txn))
    return round_doubles(df.select("transaction_id", "amount_zscore", "transaction_size",
                                   "high_amount_flag", "high_quantity_flag"))


@register("A2_A4_customer_aggregates")
def q_cust(spark, sf_dir):
    df = feat.customer_aggregates(_txn(spark, sf_dir))
    return round_doubles(df.drop("_n_rows"))


@register("A6_daily_counts")
def q_daily(spark, sf_dir):
    # the day as ISO text, so both engines hash the same value
    d = feat.daily_counts(_txn(spark, sf_dir))
    return d.withColumn("transaction_day", F.date_format("transaction_day", "yyyy-MM-dd"))


@register("A7_daily_velocity")
def q_velocity(spark, sf_dir):
    return round_doubles(feat.daily_velocity(_txn(spark, sf_dir)))


def _features(spark, sf_dir, persist: bool = False):
    """Feature table; persisted when one query runs several fits over it."""
    f = feat.feature_table(_txn(spark, sf_dir))
    return f.persist(StorageLevel.MEMORY_AND_DISK) if persist else f


@register("W_history_features")
def q_hist(spark, sf_dir):
    return round_doubles(_features(spark, sf_dir).select(
        "transaction_id", "customer_id", "time_since_last_transaction",
        "amount_deviation_from_history"))


def _gaps(spark, sf_dir):
    return fixture_gaps(spark, sf_dir)


#: Rows of a customer's part in the queries that split customers: far fewer than by default.
SPLIT_ROWS = 500


@register("W_history_split")
def q_hist_split(spark, sf_dir):
    """W1-W3 where one customer has a third of all rows, ids and dates have gaps, and customers are split."""
    txn = _gaps(spark, sf_dir)
    return round_doubles(feat.feature_table(txn, chunk_rows=SPLIT_ROWS).select(
        "transaction_id", "customer_id", "time_since_last_transaction", "amount_deviation_from_history", "total_customer_transactions",
        "avg_customer_transaction", "std_customer_transaction", "max_customer_transaction", "product_category_diversity", "avg_daily_transaction_velocity"))


@register("W_past_split")
def q_past_split(spark, sf_dir):
    """The customer aggregates as of each row, over split customers."""
    return round_doubles(feat.past_customer_features(_gaps(spark, sf_dir), chunk_rows=SPLIT_ROWS))


@register("I_interactions")
def q_inter(spark, sf_dir):
    return round_doubles(_features(spark, sf_dir).select(
        "transaction_id", "amount_age_interaction", "amount_velocity_interaction",
        "new_account_high_value", "weekend_high_value", "high_risk_profile",
        "velocity_deviation", "suspicious_pattern"))


@register("FEATURES_table")
def q_features(spark, sf_dir):
    return round_doubles(_features(spark, sf_dir))


# --------------------------------------------------------------------------
# Profiling and location leakage
# --------------------------------------------------------------------------
from ..operators import profile as prof  # noqa: E402
from ..operators import location as locn  # noqa: E402
from ..operators import prepare as prep  # noqa: E402
from ..operators import split as splt  # noqa: E402
from ..operators import weights as wts  # noqa: E402


@register("S2_overview")
def q_s2(spark, sf_dir):
    return round_doubles(prof.dataset_overview(_txn(spark, sf_dir)))


@register("S2_class_counts")
def q_s2c(spark, sf_dir):
    return prof.class_counts(_txn(spark, sf_dir))


@register("S3_numeric_profile")
def q_s3(spark, sf_dir):
    return round_doubles(prof.numeric_profile(_txn(spark, sf_dir)))


@register("S4_categorical_profile")
def q_s4(spark, sf_dir):
    return prof.categorical_profile(_txn(spark, sf_dir))


@register("A8_location_rates")
def q_a8(spark, sf_dir):
    return round_doubles(locn.location_rates(_txn(spark, sf_dir)).drop("n_positive"))


@register("T1_top_locations")
def q_t1(spark, sf_dir):
    return round_doubles(locn.top_locations(locn.location_rates(_txn(spark, sf_dir))))


@register("T1_bottom_locations")
def q_t1b(spark, sf_dir):
    return round_doubles(locn.top_locations(locn.location_rates(_txn(spark, sf_dir)), bottom=True))


@register("F18_extreme_locations")
def q_f18(spark, sf_dir):
    return locn.extreme_counts(locn.location_rates(_txn(spark, sf_dir)))


@register("A9_leakage_correlation")
def q_a9(spark, sf_dir):
    return round_doubles(locn.leakage_correlation(locn.location_rates(_txn(spark, sf_dir))))


@register("V13_location_report")
def q_v13(spark, sf_dir):
    return round_doubles(locn.location_report(_txn(spark, sf_dir)))


@register("J3_location_lookup")
def q_j3(spark, sf_dir):
    txn = _txn(spark, sf_dir)
    rates = locn.location_rates(txn).select("customer_location", "fraud_rate")
    return round_doubles(locn.lookup_join(txn.select("transaction_id", "customer_location"),
                                          rates, "customer_location"))


# --------------------------------------------------------------------------
# Preparation, split, scaling, rebalancing weights
# --------------------------------------------------------------------------
def _selected(spark, sf_dir):
    return prep.select_features(_features(spark, sf_dir, persist=True))


@register("A10_median_mode")
def q_a10(spark, sf_dir):
    x = _selected(spark, sf_dir)
    return round_doubles(prof.median_mode(x, prep.numeric_columns(x), prep.imputable_strings(x)))


def _imputed(spark, sf_dir):
    x = _selected(spark, sf_dir)
    return prep.impute(x, prep.fit_imputer(x))


@register("E1_imputed")
def q_e1(spark, sf_dir):
    return round_doubles(_imputed(spark, sf_dir))


@register("E1_imputed_gaps")
def q_e1g(spark, sf_dir):
    """E1 where amounts, quantities, ages, account ages, categories and locations have gaps."""
    x = prep.select_features(feat.feature_table(_gaps(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK))
    return round_doubles(prep.impute(x, prep.fit_imputer(x)))


@register("E2_label_encoding")
def q_e2(spark, sf_dir):
    x = _imputed(spark, sf_dir)
    out = prep.label_encode(x, prep.fit_label_encoder(x))
    return out.select("transaction_id", *[c for c in out.columns if c.endswith("_index")])


@register("E3_one_hot")
def q_e3(spark, sf_dir):
    x = _imputed(spark, sf_dir)
    kept = prep.fit_one_hot(x)
    out = prep.one_hot(x, kept)
    return out.select("transaction_id", *[c for c in out.columns if c not in x.columns])


def _prepared(spark, sf_dir):
    return prep.prepare(_features(spark, sf_dir, persist=True))


@register("E4_target_encoding")
def q_e4(spark, sf_dir):
    return round_doubles(_prepared(spark, sf_dir).select("transaction_id", "customer_location"))


@register("D1_split")
def q_d1(spark, sf_dir):
    return splt.stratified_split(_txn(spark, sf_dir).select("transaction_id", "is_fraudulent"))


@register("A11_class_balance")
def q_a11(spark, sf_dir):
    s = splt.stratified_split(_txn(spark, sf_dir).select("transaction_id", "is_fraudulent"))
    return round_doubles(prof.class_balance(s))


def _scaled(spark, sf_dir):
    # the split cuts and the scaler both read the prepared table: keep it
    p = _prepared(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    s = splt.stratified_split(p)
    cols = prep.design_columns(p)
    scaler = splt.fit_scaler(s.where(F.col("split") == "train"), cols)
    return splt.standardize(s, scaler), cols


@register("D2_standardize")
def q_d2(spark, sf_dir):
    s, cols = _scaled(spark, sf_dir)
    return round_doubles(s.select("transaction_id", "split", *cols))


@register("D3_variance_filter")
def q_d3(spark, sf_dir):
    s, cols = _scaled(spark, sf_dir)
    v = splt.column_variances(s.where(F.col("split") == "train"), cols)
    return round_doubles(v.withColumn("kept", F.col("variance") > F.lit(0.01)))


def _train_ids(spark, sf_dir):
    s = splt.stratified_split(_txn(spark, sf_dir).select("transaction_id", "is_fraudulent"))
    return s.where(F.col("split") == "train").drop("split")


@register("B4_undersample")
def q_b4(spark, sf_dir):
    return wts.undersample(_train_ids(spark, sf_dir), ratio=0.5)


@register("B5_class_weights")
def q_b5(spark, sf_dir):
    t = _train_ids(spark, sf_dir)
    rec = wts.class_weights(t, "recall", weight_col="weight_recall")
    rec = wts.class_weights(rec, "precision", weight_col="weight_precision")
    return round_doubles(wts.class_weights(rec, "balanced", weight_col="weight_balanced"))


# --------------------------------------------------------------------------
# Thresholds, blend and evaluation on the deterministic `scores` fixture
# --------------------------------------------------------------------------
from ..sources.scores import FIXED_INTERCEPT, SCORE_MULTIPLIERS, fixed_coefficient, scores_from_transactions  # noqa: E402
from ..operators import threshold as thr  # noqa: E402
from ..operators import ensemble as ens  # noqa: E402
from ..operators import evaluate as ev  # noqa: E402

BASE_MODELS = [m for m, _ in SCORE_MULTIPLIERS]


def _scores(spark, sf_dir):
    return fixture_scores(spark, sf_dir)


def _eval_scores(spark, sf_dir):
    """Base + ensemble scores with the D1 split of their rows."""
    txn = _txn(spark, sf_dir)
    base = scores_from_transactions(txn)
    allm = base.unionByName(ens.blend_long(base, models=BASE_MODELS))
    split = (splt.stratified_split(txn.select("transaction_id", "is_fraudulent"))
             .select(F.col("transaction_id").alias("row_id"), "split"))
    return allm.join(split, "row_id").persist(StorageLevel.MEMORY_AND_DISK)


def _val_thresholds(s):
    return thr.profile_thresholds(s.where(F.col("split") == "val"))


def _test_pred(spark, sf_dir):
    s = _eval_scores(spark, sf_dir)
    return ev.predict(s.where(F.col("split") == "test").drop("split"), _val_thresholds(s))


@register("L6_threshold_search")
def q_l6(spark, sf_dir):
    return round_doubles(thr.optimize_threshold(_scores(spark, sf_dir), beta=1.0))


@register("L6_threshold_cost")
def q_l6c(spark, sf_dir):
    return round_doubles(thr.optimize_threshold(_scores(spark, sf_dir), optimize_for="cost",
                                                cost_fp=1.0, cost_fn=5.0))


@register("L6_threshold_table")
def q_l6t(spark, sf_dir):
    return round_doubles(thr.threshold_table(_scores(spark, sf_dir), beta=2.0))


@register("L7_threshold_profiles")
def q_l7(spark, sf_dir):
    return round_doubles(_val_thresholds(_eval_scores(spark, sf_dir)))


@register("L8_blend")
def q_l8(spark, sf_dir):
    return round_doubles(ens.blend_long(_scores(spark, sf_dir), models=BASE_MODELS))


@register("L9_stage_counts")
def q_l9(spark, sf_dir):
    s = _eval_scores(spark, sf_dir)
    val = s.where(F.col("split") == "val").drop("split")
    base = val.where(F.col("model") != "ensemble")
    return round_doubles(ens.stage_counts(base, _val_thresholds(s)))


@register("L10_focal_loss")
def q_l10(spark, sf_dir):
    return round_doubles(ev.focal_loss(_scores(spark, sf_dir)))


@register("L11_batch_scoring")
def q_l11(spark, sf_dir):
    return round_doubles(_test_pred(spark, sf_dir).select("row_id", "model", "label", "proba",
                                                          "threshold", "pred"))


def _test_scores(spark, sf_dir):
    s = _eval_scores(spark, sf_dir)
    return s.where(F.col("split") == "test").drop("split")


@register("V1_metrics")
def q_v1(spark, sf_dir):
    pred = _test_pred(spark, sf_dir)
    return round_doubles(ev.metric_table(pred, ev.auc_table(pred)))


@register("V2_confusion")
def q_v2(spark, sf_dir):
    return ev.confusion_matrix(_test_pred(spark, sf_dir))


@register("V3_classification_report")
def q_v3(spark, sf_dir):
    return round_doubles(ev.classification_report(_test_pred(spark, sf_dir)))


@register("V4_roc_curve")
def q_v4(spark, sf_dir):
    return round_doubles(ev.roc_points(_test_scores(spark, sf_dir)))


@register("V4_roc_curve_pruned")
def q_v4p(spark, sf_dir):
    return round_doubles(ev.roc_points(_test_scores(spark, sf_dir), drop_intermediate=True))


@register("V4_auc")
def q_v4a(spark, sf_dir):
    return round_doubles(ev.auc_table(_test_scores(spark, sf_dir)))


@register("V5_pr_curve")
def q_v5(spark, sf_dir):
    return round_doubles(ev.pr_points(_test_scores(spark, sf_dir)))


@register("V6_metric_comparison")
def q_v6(spark, sf_dir):
    pred = _test_pred(spark, sf_dir)
    return round_doubles(ev.metric_comparison(ev.metric_table(pred, ev.auc_table(pred))))


def _error_slices(spark, sf_dir, overlapping):
    txn = _txn(spark, sf_dir)
    pred = _test_pred(spark, sf_dir)
    feats = feat.feature_table(txn)
    median_amount = exact_quantiles(txn, {"a": F.col("transaction_amount")}, [0.5])["a"][0]
    rates = locn.location_rates(txn)
    return round_doubles(ev.error_slices(pred, feats, rates, median_amount,
                                         overlapping=overlapping))


@register("V11_error_slices")
def q_v11(spark, sf_dir):
    return _error_slices(spark, sf_dir, False)


@register("V11_error_slices_overlapping")
def q_v11o(spark, sf_dir):
    return _error_slices(spark, sf_dir, True)


# --------------------------------------------------------------------------
# Design matrix, kNN, resampling, models and explanations
# --------------------------------------------------------------------------
from . import workflow as wf  # noqa: E402
from ..operators import knn as knn_op  # noqa: E402
from ..operators import balance as bal  # noqa: E402
from ..operators import models as mdl  # noqa: E402
from ..operators import explain as xp  # noqa: E402
from ..operators import many_models as mm  # noqa: E402
from ..operators import tree_shapley as tshap  # noqa: E402

_DESIGN_CACHE: dict = {}


def _session_key(spark, sf_dir, *extra):
    """Cache key: the running application (ids of stopped sessions can be reused)."""
    return (spark.sparkContext.applicationId, id(spark), sf_dir, *extra)


def _design(spark, sf_dir):
    """Design matrix (fit on all rows, the reference's behaviour), persisted
    once per session and input folder."""
    key = _session_key(spark, sf_dir)
    if key not in _DESIGN_CACHE:
        _DESIGN_CACHE[key] = wf.build_design(_txn(spark, sf_dir), fit="all")   # SQL parity
    return _DESIGN_CACHE[key]


def _train(spark, sf_dir):
    d = _design(spark, sf_dir).df
    return d.where(F.col("split") == "train")


@register("D2_train_design")
def q_d2t(spark, sf_dir):
    """The leak-free design of the rows with gaps: a sum of all its columns, each times a fixed coefficient."""
    dm = wf.build_design(_gaps(spark, sf_dir), fit="train")
    coefficients = F.array(*[F.lit(fixed_coefficient(n)) for n in dm.names])
    margin = F.aggregate(F.zip_with("features_arr", coefficients, lambda x, c: x * c), F.lit(FIXED_INTERCEPT), lambda a, b: a + b)
    return round_doubles(dm.df.select("row_id", "split", margin.alias("margin")))


@register("K1_knn_minority")
def q_k1(spark, sf_dir):
    t = _train(spark, sf_dir).where(F.col("label") == 1.0)
    nb = knn_op.knn(t, t, 5, "row_id", "row_id", "features_arr")
    return round_doubles(nb.select(F.col("qid").alias("query_id"), F.col("cid").alias("neighbor_id"),
                                   F.col("rank").cast("bigint").alias("rank"),
                                   F.col("dist").alias("distance")))


def _balanced(spark, sf_dir, strategy):
    out = wf.rebalance(_train(spark, sf_dir), strategy)
    total = F.aggregate("features_arr", F.lit(0.0), lambda a, x: a + x)
    return round_doubles(out.select("row_id", F.col("label").cast("int").alias("label"), "synthetic", total.alias("feature_sum")))


@register("B1_smote")
def q_b1(spark, sf_dir):
    return _balanced(spark, sf_dir, "smote")


@register("B2_adasyn")
def q_b2(spark, sf_dir):
    return _balanced(spark, sf_dir, "adasyn")


@register("B3_hybrid")
def q_b3(spark, sf_dir):
    return _balanced(spark, sf_dir, "hybrid")


_MODEL_CACHE: dict = {}


def _balanced_rows(spark, sf_dir):
    """The rebalanced rows, kept as arrays only: vectors are made where they are read."""
    key = _session_key(spark, sf_dir, "smote")
    if key not in _MODEL_CACHE:
        kept = wf.rebalance(_train(spark, sf_dir), "smote").drop("features").persist(StorageLevel.MEMORY_AND_DISK)
        _MODEL_CACHE[key] = mdl.from_array(kept, "features_arr")
    return _MODEL_CACHE[key]


# Sizes of the registered models, the same at every table size: the least points
# of the tuning grids (forest, boosting), and a network that Spark's trainer fits
# in minutes. The trainers' own defaults are the full-size models.
QUERY_MODELS = {"rf": {"n_trees": 300, "max_depth": 20}, "gbt": {"n_iter": 100, "max_depth": 5},
                "nn": {"hidden": (128, 64), "max_iter": 100}}


FOCAL_QUERY = {"hidden": (128, 64), "epochs": 30}


def _model(spark, sf_dir, name):
    """One fitted model (QUERY_MODELS), cached."""
    key = _session_key(spark, sf_dir, name)
    if key not in _MODEL_CACHE:
        dm = _design(spark, sf_dir)
        _MODEL_CACHE[key] = wf.train_model(name, _balanced_rows(spark, sf_dir), len(dm.names),
                                           **QUERY_MODELS.get(name, {}))
    return _MODEL_CACHE[key]


def _models(spark, sf_dir):
    return {n: _model(spark, sf_dir, n) for n in ("lr", "rf", "nn", "gbt")}


def clear_caches():
    _DESIGN_CACHE.clear()
    _MODEL_CACHE.clear()


def _test_rows(spark, sf_dir):
    return _design(spark, sf_dir).df.where(F.col("split") == "test")


def _model_scores(name):
    def fn(spark, sf_dir):
        m = _model(spark, sf_dir, name)
        return round_doubles(mdl.score(m, _test_rows(spark, sf_dir), name))
    return fn


Q["L1_logistic_regression"] = _model_scores("lr")
Q["L2_random_forest"] = _model_scores("rf")
Q["L3_boosted_trees"] = _model_scores("gbt")
Q["L4_neural_network"] = _model_scores("nn")


@register("L4_focal_network")
def q_l4f(spark, sf_dir):
    """The network with class weights, focal loss and early stop, on the unbalanced training rows."""
    key = _session_key(spark, sf_dir, "focal")
    if key not in _MODEL_CACHE:
        dm = _design(spark, sf_dir)
        val = dm.df.where(F.col("split") == "val")
        _MODEL_CACHE[key] = wf.train_model("nn", _train(spark, sf_dir), len(dm.names), "recall", validation=val, **FOCAL_QUERY)
    return round_doubles(mdl.score(_MODEL_CACHE[key], _test_rows(spark, sf_dir), "focal"))


@register("L5_folds")
def q_l5f(spark, sf_dir):
    return mdl.fold_column(_train(spark, sf_dir).select("row_id", "label"), 5)


@register("L5_grid_search")
def q_l5(spark, sf_dir):
    """All 12 regression points over 5 folds and all rows, in one many-model fit."""
    train = mdl.fold_column(wts.class_weights(_train(spark, sf_dir), "recall", label="label"), 5)
    sw = train.agg(F.sum("weight")).first()[0]
    points = [(c, p) for c in mdl.LR_CS for p in mdl.LR_PENALTIES]
    f1, _, _ = mm.grid_search_many(train, [(1.0 / (c * sw), float(p == "l1")) for c, p in points], 5)
    best = max(range(len(points)), key=lambda i: f1[i])
    rows = [(c, p, float(m), i == best) for i, ((c, p), m) in enumerate(zip(points, f1))]
    return round_doubles(spark.createDataFrame(rows, "C double, penalty string, mean_f1 double, best boolean"))


@register("V7_tree_importance")
def q_v7(spark, sf_dir):
    dm = _design(spark, sf_dir)
    pairs = xp.tree_importances(_model(spark, sf_dir, "rf"), dm.names, top=15)
    return xp.importance_frame(spark, pairs)


@register("V8_permutation_importance")
def q_v8(spark, sf_dir):
    dm = _design(spark, sf_dir)
    return round_doubles(xp.permutation_importance(_model(spark, sf_dir, "lr"),
                                                   _test_rows(spark, sf_dir), dm.names))


def _shap(spark, sf_dir):
    dm = _design(spark, sf_dir)
    return xp.linear_shapley(_model(spark, sf_dir, "lr"), _test_rows(spark, sf_dir), dm.names,
                             _train(spark, sf_dir))


@register("V9_linear_shapley")
def q_v9(spark, sf_dir):
    return round_doubles(_shap(spark, sf_dir))


@register("V10_mean_abs_attribution")
def q_v10(spark, sf_dir):
    return round_doubles(xp.mean_abs_attribution(_shap(spark, sf_dir)))


def _fixed(spark, sf_dir):
    return mdl.LinearScorer([fixed_coefficient(n) for n in _design(spark, sf_dir).names], FIXED_INTERCEPT)


@register("L1_fixed_scores")
def q_l1f(spark, sf_dir):
    return round_doubles(mdl.score(_fixed(spark, sf_dir), _test_rows(spark, sf_dir), "fixed"))


def _ensemble(spark, sf_dir):
    return ens.EnsembleModel(_models(spark, sf_dir))


@register("L8_ensemble_model")
def q_l8m(spark, sf_dir):
    """The blend as a model: saved, loaded again and applied to the test rows."""
    path = sinks.save_model(_ensemble(spark, sf_dir), spark, "ensemble")
    return round_doubles(mdl.score(ens.EnsembleModel.load(path), _test_rows(spark, sf_dir), "ensemble"))


@register("V9_ensemble_shapley")
def q_v9e(spark, sf_dir):
    return round_doubles(xp.sampled_shapley(_ensemble(spark, sf_dir), _test_rows(spark, sf_dir), _design(spark, sf_dir).names, _train(spark, sf_dir), n_perm=2))


@register("V8_fixed_importance")
def q_v8f(spark, sf_dir):
    return round_doubles(xp.permutation_importance(_fixed(spark, sf_dir), _test_rows(spark, sf_dir), _design(spark, sf_dir).names))


@register("V8_fixed_importance_f1")
def q_v8f1(spark, sf_dir):
    return round_doubles(xp.permutation_importance(_fixed(spark, sf_dir), _test_rows(spark, sf_dir), _design(spark, sf_dir).names, metric="f1"))


@register("T2_top_importances")
def q_t2(spark, sf_dir):
    return round_doubles(xp.top_features(xp.permutation_importance(_fixed(spark, sf_dir), _test_rows(spark, sf_dir), _design(spark, sf_dir).names)))


def _fixed_shap(spark, sf_dir):
    return xp.linear_shapley(_fixed(spark, sf_dir), _test_rows(spark, sf_dir), _design(spark, sf_dir).names, _train(spark, sf_dir))


@register("V9_fixed_shapley")
def q_v9f(spark, sf_dir):
    return round_doubles(_fixed_shap(spark, sf_dir))


@register("V10_fixed_attribution")
def q_v10f(spark, sf_dir):
    return round_doubles(xp.mean_abs_attribution(_fixed_shap(spark, sf_dir)))


def _tree_shap(name):
    def fn(spark, sf_dir):
        return round_doubles(tshap.tree_shapley(_model(spark, sf_dir, name), _test_rows(spark, sf_dir), _design(spark, sf_dir).names))
    return fn


Q["V9_forest_shapley"] = _tree_shap("rf")
Q["V9_boosted_shapley"] = _tree_shap("gbt")


@register("V9_local_accuracy")
def q_v9a(spark, sf_dir):
    """Whether each test row's attributions and the base value add up to the boosted trees' log-odds."""
    model, rows = _model(spark, sf_dir, "gbt"), _test_rows(spark, sf_dir)
    sums = tshap.tree_shapley(model, rows, _design(spark, sf_dir).names).groupBy("row_id").agg(F.sum("shap").alias("shap"))
    p = F.col("proba")
    gap = F.abs(F.col("shap") + F.lit(tshap.base_value(model)) - F.log(p / (1 - p)))
    return mdl.score(model, rows, "gbt").join(sums, "row_id").select("row_id", (gap < 1e-6).alias("adds_up"))


@register("V12_feature_ablation")
def q_v12(spark, sf_dir):
    return round_doubles(wf.feature_ablation(_design(spark, sf_dir)))


@register("S5_parquet_roundtrip")
def q_s5(spark, sf_dir):
    path = sinks.write_table(_features(spark, sf_dir), spark, "features")
    return round_doubles(spark.read.parquet(path))


@register("V9_sampled_shapley")
def q_v9s(spark, sf_dir):
    dm = _design(spark, sf_dir)
    return round_doubles(xp.sampled_shapley(_model(spark, sf_dir, "gbt"), _test_rows(spark, sf_dir),
                                            dm.names, _train(spark, sf_dir)))


@register("W_past_customer_features")
def q_past(spark, sf_dir):
    return round_doubles(feat.past_customer_features(_txn(spark, sf_dir)))
