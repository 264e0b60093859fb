"""Exact tree attributions: against all subsets on small trees, and local accuracy of whole models."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import models as mdl, tree_shapley as ts


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) * 0.3 > 0.4).astype(float)
    df = spark.createDataFrame([(i, a.tolist(), float(b), 1.0 + (i % 3)) for i, (a, b) in enumerate(zip(x, y))], "row_id long, features_arr array<double>, label double, weight double")
    return mdl.from_array(df, "features_arr").persist()


def expected(nodes, x, known):
    """The tree's output where only some features are known: others go both ways, by cover."""
    def go(k):
        n = nodes[k]
        if n["left"] < 0:
            return n["value"]
        if n["feature"] in known:
            return go(n["left"] if x[n["feature"]] <= n["cut"] else n["right"])
        a, b = nodes[n["left"]], nodes[n["right"]]
        return (a["cover"] * go(n["left"]) + b["cover"] * go(n["right"])) / n["cover"]
    return go(0)


def brute(trees, x, d):
    phi = np.zeros(d)
    for j in range(d):
        others = [k for k in range(d) if k != j]
        for r in range(d):
            for s in itertools.combinations(others, r):
                w = math.factorial(r) * math.factorial(d - r - 1) / math.factorial(d)
                phi[j] += w * sum(expected(t, x, {*s, j}) - expected(t, x, set(s)) for t in trees)
    return phi


def spark_trees(model, boosted):
    """Node tables through the model's own node objects, not its saved form."""
    out = []
    weights = list(model.treeWeights)
    scale = 2.0 if boosted else 1 / sum(weights)
    for tree, w in zip(model.trees, weights):
        nodes = []

        def add(node):
            k = len(nodes)
            stats = list(node.impurityStats().stats())
            nodes.append({"cover": stats[0] if boosted else sum(stats), "left": -1,
                          "value": scale * w * (node.prediction() if boosted else stats[1] / sum(stats))})
            if node.subtreeDepth() > 0:
                s = node.split()
                nodes[k] |= {"feature": s.featureIndex(), "cut": s.threshold(), "left": add(node.leftChild()), "right": add(node.rightChild())}
            return k
        add(tree._java_obj.rootNode())
        out.append(nodes)
    return out


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_equals_all_subsets(spark, rows, kind):
    model = mdl.random_forest(rows, n_trees=4, max_depth=4) if kind == "rf" else mdl.boosted_trees(rows, n_iter=4, max_depth=4)
    x = np.array([r.features_arr for r in rows.orderBy("row_id").limit(12).collect()])
    trees = spark_trees(model, kind == "gbt")
    got = ts.attributions(x, ts.model_leaves(model))
    for i in range(len(x)):
        assert got[i] == pytest.approx(brute(trees, x[i], 5), abs=1e-9)


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_values_add_up_to_the_output(spark, rows, monkeypatch, kind):
    model = mdl.random_forest(rows, n_trees=12, max_depth=9) if kind == "rf" else mdl.boosted_trees(rows, n_iter=12, max_depth=6)
    names = list("abcde")
    sums = {}
    for size in (ts.GROUP_BYTES, 1):  # one group of trees, and a pass for each tree
        monkeypatch.setattr(ts, "GROUP_BYTES", size)
        long = ts.tree_shapley(model, rows, names)
        assert long.columns == ["row_id", "feature", "shap"] and long.count() == 400 * 5
        sums[size] = {r.row_id: r.s for r in long.groupBy("row_id").agg(F.sum("shap").alias("s")).collect()}
    base = ts.base_value(model)
    p = {r.row_id: r.proba for r in mdl.score(model, rows, kind).collect()}
    for i, q in p.items():
        f = q if kind == "rf" else math.log(q / (1 - q))
        assert all(s[i] + base == pytest.approx(f, abs=1e-7) for s in sums.values())


def test_a_single_leaf_and_no_rows(spark, rows):
    flat = mdl.boosted_trees(rows.withColumn("features", array_to_vector(F.array(*[F.lit(0.0)] * 5))), n_iter=1, max_depth=2)
    out = ts.tree_shapley(flat, rows, list("abcde"))
    assert out.agg(F.max(F.abs("shap"))).first()[0] == 0.0
    assert ts.tree_shapley(flat, rows.where("row_id < 0"), list("abcde")).count() == 0
