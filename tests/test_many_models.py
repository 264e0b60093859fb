"""Many logistic regressions at once: equal to Spark's separate fits."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskloom.operators import many_models as mm, models as mdl


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 6))
    y = (x @ [1.0, -2.0, 0.5, 0.0, 0.0, 0.1] + rng.normal(size=1500) > 1.2).astype(float)
    data = [(str(i), a.tolist(), float(b), 10.0 if b else 1.0) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "row_id string, features_arr array<double>, label double, weight double")
    return mdl.fold_column(mdl.from_array(df, "features_arr"), 3).repartition(5).persist()


def separate(train, reg, l1):
    m = LogisticRegression(weightCol="weight", regParam=reg, elasticNetParam=l1, standardization=False, maxIter=500, tol=1e-10).fit(train)
    return np.append(m.coefficients.toArray(), m.intercept)


def test_equal_to_separate_fits(spark, rows, monkeypatch):
    monkeypatch.setattr(mm, "BLOCK_ROWS", 100)
    tasks = [mm.Task(r, a, f) for r in (0.001, 0.05) for a in (0.0, 1.0, 0.5) for f in (None, 1)] + [mm.Task(0.01, 0.0, None, (0, 2, 5)), mm.Task(0.0, 0.0, 2)]
    blocks = mm.Blocks(rows)
    got, passes = mm.fit_many(blocks, tasks, tol=1e-10)
    alone, _ = mm.fit_many(blocks, tasks[:1], tol=1e-10)
    blocks.close()
    assert got[0] == pytest.approx(alone[0], abs=1e-9)
    assert passes < 120
    for t, c in zip(tasks, got):
        train = rows if t.leave_out is None else rows.where(F.col("fold") != t.leave_out)
        if t.features is not None:
            train = mdl.from_array(train.withColumn("features_arr", F.array(*[F.col("features_arr")[i] for i in t.features])), "features_arr")
            assert (np.delete(c[:-1], t.features) == 0).all()
            c = np.append(c[list(t.features)], c[-1])
        assert c == pytest.approx(separate(train, t.reg, t.l1), abs=2e-3)
        if t.l1 == 1.0 and t.reg == 0.05:
            assert (c[:-1] == 0).sum() >= 2


def test_grid_search_scores_each_fold_as_separate_fits(spark, rows):
    grid = [(0.001, 0.0), (0.1, 1.0)]
    f1, whole, _ = mm.grid_search_many(rows, grid, k=3)
    for (reg, l1), score, c in zip(grid, f1, whole):
        want = []
        for k in range(3):
            b = separate(rows.where(F.col("fold") != k), reg, l1)
            held = rows.where(F.col("fold") == k).select("features_arr", "label").toPandas()
            said = np.vstack(held.features_arr) @ b[:-1] + b[-1] > 0
            tp, wrong = (said & (held.label == 1)).sum(), (said != (held.label == 1)).sum()
            want.append(2 * tp / (2 * tp + wrong))
        assert score == pytest.approx(np.mean(want), abs=0.01)
        assert c == pytest.approx(separate(rows, reg, l1), abs=5e-3)


def test_the_result_does_not_depend_on_partitioning(spark, rows):
    out = []
    for n in (1, 7):
        blocks = mm.Blocks(rows.repartition(n))
        out.append(mm.fit_many(blocks, [mm.Task(0.01, 1.0), mm.Task(0.01, 0.0)])[0])
        blocks.close()
    assert out[0] == pytest.approx(out[1], abs=1e-6)
    with pytest.raises(ValueError):
        mm.Blocks(rows.where("label > 5"))
