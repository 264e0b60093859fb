"""Evaluation operators on hand-made tables: one class only, all scores equal,
"""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as ev, threshold as thr


def _scores(spark, rows):
    return spark.createDataFrame(rows, "row_id string, label int, model string, proba double")


def test_one_class_gives_null_auc_and_fallback_threshold(spark):
    s = _scores(spark, [(str(i), 0, "m", i / 10) for i in range(10)])
    assert ev.auc_table(s).first()["auc"] is None
    t = thr.optimize_threshold(s).first()
    assert t["threshold"] == 0.5 and t["f_beta"] == 0.0


def test_all_scores_equal_give_half_auc(spark):
    s = _scores(spark, [(str(i), i % 2, "m", 0.3) for i in range(10)])
    assert ev.auc_table(s).first()["auc"] == pytest.approx(0.5)
    roc = ev.roc_points(s).toPandas()
    assert sorted(zip(roc.fpr, roc.tpr)) == [(0.0, 0.0), (1.0, 1.0)]


def test_confusion_cells_are_zero_filled(spark):
    s = _scores(spark, [("a", 0, "m", 0.1), ("b", 0, "m", 0.2)])
    cm = ev.confusion_matrix(ev.predict(s, {"m": 0.5})).toPandas()
    assert len(cm) == 4 and cm.n.sum() == 2 and (cm.n == 0).sum() == 3


PUBLISHED = {"lr": (95071, 786, 0.566, 0.098, 0.929, 0.177),
             "rf": (92797, 882, 0.576, 0.099, 0.920, 0.179),
             "nn": (1454, 8231, 0.956, 0.662, 0.257, 0.370),
             "xgb": (1362, 8381, 0.956, 0.664, 0.243, 0.356),
             "ensemble": (18993, 4286, 0.895, 0.263, 0.613, 0.368)}
N_ROWS, N_POS = 220943, 11076


def test_metrics_reproduce_published_rates(spark):
    ids = spark.range(N_ROWS).withColumn("label", (F.col("id") < N_POS).cast("int"))
    out = None
    for m, (fp, fn, *_rest) in PUBLISHED.items():
        # positives: first fn are missed; negatives: first fp are flagged
        pred = (F.when(F.col("label") == 1, (F.col("id") >= fn).cast("int"))
                .otherwise((F.col("id") < N_POS + fp).cast("int")))
        x = ids.select(F.lit(m).alias("model"), "label", pred.alias("pred"))
        out = x if out is None else out.unionByName(x)
    got = {r["model"]: r for r in ev.metric_table(out).collect()}
    for m, (fp, fn, acc, prec, rec, f1) in PUBLISHED.items():
        r = got[m]
        assert r["accuracy"] == pytest.approx(acc, abs=6e-3)
        assert r["precision"] == pytest.approx(prec, abs=6e-3)
        assert r["recall"] == pytest.approx(rec, abs=6e-3)
        assert r["f1"] == pytest.approx(f1, abs=6e-3)
    rep = {(r["model"], r["row_name"]): r for r in ev.classification_report(out).collect()}
    assert rep[("lr", "Fraudulent")]["support"] == N_POS
    assert rep[("lr", "accuracy")]["support"] == N_ROWS
    assert rep[("ensemble", "Legitimate")]["recall"] == pytest.approx(1 - 18993 / (N_ROWS - N_POS))
