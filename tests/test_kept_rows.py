"""What the linear trainer and the registered models keep besides their input."""

from contextlib import contextmanager

import numpy as np

from riskloom.operators import models as mdl
from riskloom.plans import queries as q, workflow as wf


def test_regression_keeps_no_second_copy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(a.tolist(), float(a[0] + a[1] > 0), 1.0 + i % 2) for i, a in enumerate(x)], "features_arr array<double>, label double, weight double")
    rows = mdl.from_array(df.repartition(4), "features_arr").persist()
    with mdl.kept_for_training(rows) as kept:
        want = mdl.LogisticRegression(regParam=1.0 / (0.5 * 450.0), standardization=False, maxIter=1000, tol=1e-4, weightCol="weight").fit(kept)

    @contextmanager
    def none(df):
        raise AssertionError("rows are kept twice")
        yield

    monkeypatch.setattr(mdl, "kept_for_training", none)
    got = mdl.logistic_regression(rows, C=0.5)
    assert got.coefficients.toArray().tolist() == want.coefficients.toArray().tolist() and got.intercept == want.intercept


def test_rebalanced_rows_are_kept_as_arrays(spark, monkeypatch):
    rows = spark.createDataFrame([(str(i), float(i % 5 == 0), [float(i), 1.0 / (i + 1)]) for i in range(40)], "row_id string, label double, features_arr array<double>")
    monkeypatch.setattr(q, "_train", lambda spark, sf_dir: rows)
    got = q._balanced_rows(spark, "kept-arrays")
    want = wf.rebalance(rows, "smote")
    assert set(got.columns) == set(want.columns)
    names = sorted(got.columns)
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    kept = [line for line in got._jdf.queryExecution().withCachedData().toString().splitlines() if "InMemoryRelation" in line]
    assert kept and all("features_arr#" in k and "features#" not in k for k in kept[:1])
