import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import quantiles
from riskloom.operators.quantiles import exact_modes, exact_quantiles

PROBS = [0.0, 0.2, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("small", [50_000, 40, 3])
def test_equal_to_sorting_at_every_bracket_size(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    rnd = random.Random(1)
    rows = [(rnd.gauss(0, 1e6), float(rnd.randrange(4)), None if rnd.random() < 0.5 else rnd.choice([1.0, 2.0]), None, 5.0) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, PROBS)
    for i, c in enumerate(df.columns):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == ([None] * len(PROBS) if not values else pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12))


@pytest.mark.parametrize("copies", [20_000, 40_000, 150_000])
def test_values_between_heavy_ends(spark, copies):
    """At the real SMALL: a sketch sees only the two ends."""
    df = spark.range(2 * copies + 21).select(F.when(F.col("id") < copies, 0.0).when(F.col("id") < copies + 21, F.col("id") - copies + 1).otherwise(1000.0).alias("x"),
                                             F.when(F.col("id") < copies, 0.0).when(F.col("id") < copies + 2, 7.0).when(F.col("id") == copies + 2, float("nan")).otherwise(9.0).alias("y"))
    got = exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, PROBS + [copies / (2 * copies + 20), (copies + 20) / (2 * copies + 20)])
    x = np.concatenate([np.zeros(copies), np.arange(1, 22), np.full(copies, 1000.0)])
    y = np.concatenate([np.zeros(copies), [7.0, 7.0], np.full(copies + 18, 9.0)])
    probs = PROBS + [copies / (2 * copies + 20), (copies + 20) / (2 * copies + 20)]
    assert got["x"] == pytest.approx(np.quantile(x, probs).tolist()) and got["x"][3] == 11.0
    assert got["y"] == pytest.approx(np.quantile(y, probs).tolist())


def test_no_rows_and_modes(spark):
    df = spark.createDataFrame([], "a double, s string")
    assert exact_quantiles(df, {"a": F.col("a")}, [0.5]) == {"a": [None]} and exact_modes(df, ["s"]) == {"s": None}
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None), ("a", "y"), (None, None)], "s string, t string")
    assert exact_modes(df, ["s", "t"]) == {"s": "a", "t": "x"}
