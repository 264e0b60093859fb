"""Model checks on a separable fixture derived from the driver's events table."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as mdl, weights as wts, evaluate as ev
from riskloom.operators import split as splt, explain as xp

from .conftest import SF_MID


def _unit(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


@pytest.fixture(scope="module")
def separable(spark):
    e = spark.read.parquet(f"{SF_MID}/events.parquet").select("event_id")
    label = (F.pmod(F.xxhash64("event_id", F.lit("y")), F.lit(20)) == 0).cast("double")
    df = e.select(F.col("event_id").cast("string").alias("row_id"), label.alias("label"),
                  (_unit("event_id", F.lit("a")) + label * 1.5).alias("f0"),
                  (_unit("event_id", F.lit("b")) + label * 1.0).alias("f1"),
                  _unit("event_id", F.lit("c")).alias("f2"),
                  F.lit(1.0).alias("f3"))
    df = splt.stratified_split(df, "label", "row_id")
    return mdl.assemble(df, ["f0", "f1", "f2", "f3"]).persist()


def _auc(model, df, name):
    s = mdl.score(model, df.where(F.col("split") == "test"), name)
    return ev.auc_table(s).first()["auc"]


def test_variance_filter_drops_constant(separable):
    kept = splt.variance_filter(separable.where(F.col("split") == "train"), ["f0", "f1", "f2", "f3"])
    assert kept == ["f0", "f1", "f2"]


def test_classifiers_separate(separable):
    train = wts.class_weights(separable.where(F.col("split") == "train"), "recall", label="label")
    models = {
        "lr": mdl.logistic_regression(train, C=1.0),
        "rf": mdl.random_forest(train, n_trees=10, max_depth=5),
        "gbt": mdl.boosted_trees(train, n_iter=10, max_depth=3),
        "nn": mdl.neural_network(train, 4, hidden=(8,), max_iter=100),
    }
    for name, m in models.items():
        assert _auc(m, separable, name) > 0.9, name
    imp = dict(xp.tree_importances(models["rf"], ["f0", "f1", "f2", "f3"], top=None))
    assert imp["f3"] == 0.0


def test_weights_change_the_fit(separable):
    train = separable.where(F.col("split") == "train")
    a = mdl.logistic_regression(wts.class_weights(train, "recall", label="label"), C=1.0)
    b = mdl.logistic_regression(train, C=1.0, weight_col=None)
    assert abs(a.intercept - b.intercept) > 1e-3


def test_saved_model_reloads_to_equal_scores(spark, separable, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel
    train = separable.where(F.col("split") == "train")
    m = mdl.logistic_regression(train, C=1.0, weight_col=None)
    p = str(tmp_path / "lr")
    m.write().overwrite().save(p)
    m2 = LogisticRegressionModel.load(p)
    test = separable.where(F.col("split") == "test")
    a = mdl.score(m, test, "lr").orderBy("row_id").toPandas()
    b = mdl.score(m2, test, "lr").orderBy("row_id").toPandas()
    assert (a.proba - b.proba).abs().max() < 1e-12


def test_fold_column_is_stratified(separable):
    f = mdl.fold_column(separable.where(F.col("split") == "train"), k=5).toPandas()
    for _, g in f.groupby("label"):
        sizes = g.fold.value_counts()
        assert sizes.max() - sizes.min() <= 1


def test_sampled_shapley_is_efficient(spark, separable):
    train = separable.where(F.col("split") == "train")
    m = mdl.boosted_trees(wts.class_weights(train, "recall", label="label"), n_iter=5, max_depth=3)
    rows = (separable.where(F.col("split") == "test").limit(40)
            .withColumn("features_arr", F.array("f0", "f1", "f2", "f3")))
    bg = train.withColumn("features_arr", F.array("f0", "f1", "f2", "f3"))
    phi = xp.sampled_shapley(m, rows, ["f0", "f1", "f2", "f3"], bg, n_perm=3).toPandas()
    assert len(phi) == 40 * 4
    # the constant feature never changes the output
    assert phi[phi.feature == "f3"].shap.abs().max() < 1e-12
    # contributions are bounded by the probability range
    assert phi.groupby("row_id").shap.sum().abs().max() <= 1.0 + 1e-9
