"""Plan checks: no single-partition windows, no Python in the
feature plan, one exchange of the row data for the history features."""

import io
import contextlib

from riskloom.operators import features as feat, evaluate as ev
from riskloom.sources.transactions import fixture_transactions
from riskloom.sources.scores import fixture_scores

from .conftest import SF_SMALL


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_feature_plan_is_jvm_only_and_partitioned(spark):
    plan = _plan(feat.feature_table(fixture_transactions(spark, SF_SMALL), has_hot=False))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PushedFilters" in plan


def test_feature_scan_prunes_columns(spark):
    txn = fixture_transactions(spark, SF_SMALL)
    plan = _plan(feat.daily_velocity(txn))
    scans = [l for l in plan.splitlines() if l.startswith("ReadSchema") and "user_id" in l]
    assert scans
    for scan in scans:      # only the customer key and timestamp are read
        assert "event_type" not in scan and "props" not in scan and "value" not in scan


def test_curves_do_not_sort_all_scores_in_one_task(spark):
    plan = _plan(ev.roc_points(fixture_scores(spark, SF_SMALL)))
    assert "SinglePartition" not in plan


def test_split_assignment_is_a_projection(spark):
    from riskloom.operators import split as splt
    txn = fixture_transactions(spark, SF_SMALL).select("transaction_id", "is_fraudulent")
    plan = _plan(splt.stratified_split(txn))
    assert "Window" not in plan and "Exchange" not in plan.split("(1)")[0]


def test_knn_never_broadcasts_candidates(spark):
    import numpy as np
    from riskloom.operators import knn as knn_op
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(f"r{i}", [float(v) for v in rng.normal(size=3)]) for i in range(50)],
                               "id string, vec array<double>")
    plan = _plan(knn_op.knn(df, df, 3, "id", "id", "vec", block_rows=20))
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan
    assert "FlatMapCoGroupsInArrow" in plan
