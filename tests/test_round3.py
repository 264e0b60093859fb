"""Explanations, the ensemble model, dense level ids, pruned curves and the CSV stream."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import ensemble as ens, evaluate as ev, explain as xp, models as mdl, prepare as prep, weights as wts
from riskloom.sources import sinks
from riskloom.sources.transactions import fixture_transactions, read_transactions
from riskloom.streaming import apply_per_batch, transaction_stream
from tools.oracle_check import frame_key

from .conftest import SF_SMALL

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[:, 3] = 1.0
    y = (x[:, 0] - x[:, 1] > 0.5).astype(float)
    df = spark.createDataFrame([(f"r{i}", a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "row_id string, features_arr array<double>, label double")
    return mdl.from_array(df, "features_arr").repartition(4).persist()


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("metric", xp.METRICS)
def test_permutation_importance_of_a_linear_scorer(spark, rows, metric):
    scorer = mdl.LinearScorer([2.0, -2.0, 0.0, 5.0], -6.0)
    got = {r.feature: r.importance for r in xp.permutation_importance(scorer, rows, NAMES, metric=metric).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and abs(got["c"]) < 1e-12 and abs(got["d"]) < 1e-12
    assert got["a"] > 0.2 and got["b"] > 0.2
    again = xp.permutation_importance(scorer, rows.repartition(1), NAMES, metric=metric).collect()
    assert {r.feature: r.importance for r in again} == got
    with pytest.raises(ValueError):
        xp.permutation_importance(scorer, rows, NAMES, metric="loss")


@pytest.mark.parametrize("kind", ["linear", "gbt"])
def test_sampled_shapley_adds_up(spark, rows, kind):
    """Without a window over the points; against one background row, a row's values sum to its output less that row's."""
    scorer = mdl.LinearScorer([1.0, -1.0, 0.0, 0.0]) if kind == "linear" else mdl.boosted_trees(rows, n_iter=4, max_depth=3)
    one = rows.where("row_id = 'r7'")
    out = xp.sampled_shapley(scorer, rows, NAMES, one, n_perm=4)
    assert "lag(" not in plan(out)  # the one window ranks the background rows
    phi = out.toPandas().pivot(index="row_id", columns="feature", values="shap")
    f = scorer.transform(rows).select("row_id", vector_to_array("probability")[1].alias("p")).toPandas().set_index("row_id").p
    assert len(phi) == 300 and (phi["d"].abs() < 1e-12).all() and ((phi["c"].abs() < 1e-12).all() or kind == "gbt")
    assert phi.sum(axis=1).to_numpy() == pytest.approx((f - f["r7"]).loc[phi.index].to_numpy(), abs=1e-12)


def test_ensemble_is_a_model(spark, rows, tmp_path):
    train = wts.class_weights(rows, "recall", label="label")
    models = {"lr": mdl.logistic_regression(train), "rf": mdl.random_forest(train, n_trees=3, max_depth=3), "gbt": mdl.boosted_trees(train, n_iter=2, max_depth=2)}
    model = ens.EnsembleModel(models, 0.4)
    scores = None
    for n, m in models.items():
        s = mdl.score(m, rows, n)
        scores = s if scores is None else scores.unionByName(s)
    want = {r.row_id: r.proba for r in ens.blend_long(scores).collect()}
    got = {r.row_id: r.proba for r in mdl.score(model, rows, "e").collect()}
    assert got == pytest.approx(want)
    path = sinks.save_model(model, spark, "blend", str(tmp_path / "blend"))
    sinks.save_model(model, spark, "blend", path)  # overwrites
    again = ens.EnsembleModel.load(path)
    assert again.threshold == 0.4 and list(again.models) == list(models)
    out = again.transform(rows).select("row_id", "prediction", vector_to_array("probability")[1].alias("p")).collect()
    assert {r.row_id: r.p for r in out} == pytest.approx(got) and all(r.prediction == float(r.p >= 0.4) for r in out)
    assert set(again.transform(rows).columns) == {*rows.columns, "probability", "prediction"}
    phi = xp.sampled_shapley(again, rows.limit(5), NAMES, rows, n_perm=2)
    assert phi.count() == 20
    with pytest.raises(ValueError):
        ens.EnsembleModel({"lr": models["lr"]})


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_pruned_curve_keeps_the_area(spark, ranges):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 60, 500) / 60
    y = (rng.random(500) < p).astype(int)
    p = np.concatenate([p, [0.999 + i * 1e-5 for i in range(20)]])  # a run of equal steps
    y = np.concatenate([y, np.ones(20, int)])
    scores = spark.createDataFrame([(str(i), int(b), "m", float(a)) for i, (a, b) in enumerate(zip(p, y))], "row_id string, label int, model string, proba double")
    s, n = np.unique(p)[::-1], len(np.unique(p))
    tps, fps = np.array([(y[p >= t] == 1).sum() for t in s]), np.array([(y[p >= t] == 0).sum() for t in s])
    keep = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True]
    got = ev.roc_points(scores, drop_intermediate=True, n_ranges=ranges).where("threshold IS NOT NULL").orderBy(F.col("threshold").desc()).collect()
    assert [r.threshold for r in got] == s[keep].tolist() and len(got) < n - 10
    x = np.r_[0, [r.fpr for r in got]], np.r_[0, [r.tpr for r in got]]
    assert np.trapezoid(x[1], x[0]) == pytest.approx(ev.auc_table(scores).first()["auc"])


def test_level_ids_are_dense_and_sorted(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), None if i % 50 == 0 else f"L{rng.integers(0, 400)}", "xyz"[i % 3], None) for i in range(2000)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_location string, device_used string, payment_method string").repartition(7)
    levels = prep.fit_label_encoder(df)
    out = prep.label_encode(df, levels).collect()
    for c, k in (("customer_location", 1), ("device_used", 2)):
        order = {v: float(i) for i, v in enumerate(sorted({r[k] for r in rows if r[k] is not None}))}
        assert all(r[f"{c}_index"] == order.get(r[c], float(len(order))) for r in out)
    assert len(out) == 2000 and {r["transaction_id"] for r in out} == {r[0] for r in rows}
    assert levels.where("column_name = 'payment_method'").count() == 0
    unseen = spark.createDataFrame([("1", "nowhere", "x", None)], df.schema)
    assert prep.label_encode(unseen, levels).first()["customer_location_index"] == levels.where("column_name = 'customer_location'").count()


def test_csv_stream_types_fields_as_the_batch_scan(spark, tmp_path):
    src = sinks.write_csv(fixture_transactions(spark, SF_SMALL).limit(50), spark, "t", str(tmp_path / "src"))
    part = next(f for f in sorted(os.listdir(src)) if f.endswith(".csv"))
    with open(f"{src}/{part}") as f:
        head = f.readline()
        row = f.readline().split(",")
    quantity = head.strip().split(",").index("Quantity")
    row[quantity] = "1.0"
    with open(f"{src}/extra.csv", "w") as f:
        f.write(head + ",".join(row))
    apply_per_batch(transaction_stream(spark, src, "csv"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    got, want = spark.read.parquet(str(tmp_path / "out")).drop("batch_id"), read_transactions(spark, src)
    assert want.where("quantity IS NULL").count() == 0 and got.count() == 51
    assert frame_key(got.toPandas()) == frame_key(want.toPandas())
