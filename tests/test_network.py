"""The focal-loss network: gradients, learning from unbalanced rows, early stop, restart, partitioning, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ensemble as ens, evaluate as ev, models as mdl, network as net, weights as wts
from riskloom.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3))
    y = ((x[:, 0] ** 2 + x[:, 1] > 2.6)).astype(float)  # a few, and not by a line
    df = spark.createDataFrame([(f"r{i}", a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "row_id string, features_arr array<double>, label double")
    df = wts.class_weights(mdl.from_array(df, "features_arr"), "recall", label="label")
    df = df.withColumn("held", F.pmod(F.xxhash64("row_id"), F.lit(4)) == 0).repartition(3).persist()
    return df.where("NOT held"), df.where("held")


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    n = net.Network((3, 4, 2, 1), seed=5)
    x, y, w = rng.normal(size=(9, 3)), (rng.random(9) < 0.5).astype(float), rng.random(9) + 0.5
    loss, grad = n.loss(x, y, w, 0.75)
    for i in range(0, len(n.flat), 3):
        at = n.flat.copy()
        at[i] += 1e-6
        assert (net.Network(n.sizes, at).loss(x, y, w, 0.75, False)[0] - loss) / 1e-6 == pytest.approx(grad[i], abs=1e-4)


def trained(train, val, state=None, **options):
    return net.focal_network(train, val, 3, **{"hidden": (16,), "batches": 2, "epochs": 8, "state": state} | options)


def test_learns_stops_and_does_not_depend_on_partitioning(spark, rows, monkeypatch):
    monkeypatch.setattr(net, "BLOCK_ROWS", 100)
    monkeypatch.setattr(net, "STEP", 0.05)
    train, val = rows
    a = trained(train, val, epochs=12)
    assert ev.auc_table(mdl.score(a, val, "nn")).first()["auc"] > 0.9
    a = trained(train, val, epochs=2)
    b = trained(train.repartition(7), val.repartition(1), epochs=2)
    assert (a.network.flat == b.network.flat).all() and a.validation_loss == b.validation_loss
    monkeypatch.setattr(net, "STEP", 5.0)  # steps too long to gain
    assert trained(train, val, epochs=9, patience=1).epochs < 9


def test_goes_on_from_a_kept_epoch(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(net, "BLOCK_ROWS", 100)
    train, val = rows
    whole = trained(train, val, epochs=2)
    state = str(tmp_path / "state")
    trained(train, val, state, epochs=1)
    again = trained(train, val, state, epochs=2)
    assert (whole.network.flat == again.network.flat).all() and again.epochs == 2


def test_saved_network_scores_alike_in_an_ensemble(spark, rows, tmp_path):
    train, val = rows
    model = trained(train, val, epochs=1)
    blend = ens.EnsembleModel({"lr": mdl.logistic_regression(train), "nn": model})
    again = ens.EnsembleModel.load(sinks.save_model(blend, spark, "e", str(tmp_path / "e")))
    a, b = ({r.row_id: r.proba for r in mdl.score(m, val, "e").collect()} for m in (blend, again))
    assert a == b and len(a) == val.count()
