"""The end-to-end flow runs and produces whole, well-formed result tables."""

import pytest
from pyspark.sql import functions as F

from riskloom.plans import workflow as wf
from riskloom.sources.transactions import fixture_transactions

from .conftest import SF_SMALL


@pytest.mark.parametrize("fit", ["all", "train"])
def test_end_to_end(spark, fit):
    txn = fixture_transactions(spark, SF_SMALL)
    out = wf.run(txn, fit=fit, strategy="adasyn", params={
        "rf": {"n_trees": 5, "max_depth": 5}, "gbt": {"n_iter": 4, "max_depth": 3}, "nn": {"hidden": (16, 8), "max_iter": 20}})
    dm = out["design"]
    n = txn.count()
    assert dm.df.count() == n                                  # every row kept
    assert dm.df.where(F.col("split") == "test").count() == out["scores"].where(
        F.col("model") == "lr").count()
    metrics = {r["model"]: r for r in out["metrics"].collect()}
    assert set(metrics) == {"lr", "rf", "nn", "gbt", "ensemble"}
    for r in metrics.values():
        assert 0.0 <= r["auc"] <= 1.0 and 0.0 <= r["accuracy"] <= 1.0
    assert out["confusion"].count() == 5 * 4
    assert out["mean_abs_shap"].count() == min(20, len(dm.names))
    # constants never reach the models (variance filter on scaled train rows)
    assert len(dm.names) <= len(dm.all_names)
