"""S1 scan from CSV with the source headers, version check, S5 sink, leak-free fit."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.sources.transactions import (SOURCE_HEADERS, read_transactions, load_version,
                                           fixture_transactions)
from riskloom.sources.sinks import write_table
from riskloom.functions.expressions import round_doubles
from riskloom.operators import prepare as prep, features as feat, split as splt
from tools.oracle_check import frame_key

from .conftest import SF_SMALL


def test_csv_scan_with_source_headers_equals_fixture(spark):
    txn = fixture_transactions(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="riskloom-csv-")
    out = os.path.join(root, "csv")
    renamed = txn.select(*[F.col(n).cast("string").alias(h) for h, n in SOURCE_HEADERS])
    renamed.write.option("header", True).csv(out)
    back = read_transactions(spark, out, "csv")
    assert back.schema == read_transactions(spark, out, "csv").schema
    a = round_doubles(back).toPandas()
    b = round_doubles(txn).toPandas()
    assert frame_key(a) == frame_key(b)


def test_version_check(spark):
    with pytest.raises(ValueError):
        load_version(spark, "v3", "/nonexistent")


def test_nan_amount_becomes_null(spark):
    root = tempfile.mkdtemp(prefix="riskloom-nan-")
    p = os.path.join(root, "t.csv")
    with open(p, "w") as f:
        f.write(",".join(h for h, _ in SOURCE_HEADERS) + "\n")
        f.write("1,c,NaN,2024-01-01 10:00:00,PayPal,clothing,1,30,L1,mobile,ip,A,A,0,10,10\n")
    r = read_transactions(spark, p, "csv").first()
    assert r["transaction_amount"] is None and r["quantity"] == 1


def test_sink_writes_under_checkpoint_dir(spark):
    df = fixture_transactions(spark, SF_SMALL).limit(5)
    path = write_table(df, spark, "probe")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.read.parquet(path).count() == 5


def test_target_encoding_fit_on_train_only(spark):
    f = splt.stratified_split(feat.feature_table(fixture_transactions(spark, SF_SMALL)))
    train = f.where(F.col("split") == "train")
    rates, prior = prep.fit_target_encoder(train)
    got = {r["customer_location"]: r["_rate"] for r in rates.collect()}
    want = {r["customer_location"]: r["r"] for r in train.groupBy("customer_location")
            .agg(F.avg(F.col("is_fraudulent").cast("double")).alias("r")).collect()}
    assert got == want
    enc = prep.target_encode(f.select("transaction_id", "customer_location"),
                             rates.where(F.col("customer_location") != "L1"), prior)
    vals = {r["transaction_id"]: r["customer_location"] for r in enc.collect()}
    l1 = [r["transaction_id"] for r in f.where(F.col("customer_location") == "L1").collect()]
    assert all(vals[i] == pytest.approx(prior) for i in l1)


def test_model_sink_under_checkpoint_dir(spark):
    from pyspark.ml.classification import LogisticRegressionModel
    from riskloom.sources.sinks import save_model
    from riskloom.operators import models as mdl
    df = spark.createDataFrame([(float(i % 2), float(i), float(i % 3)) for i in range(40)],
                               "label double, a double, b double")
    x = mdl.assemble(df, ["a", "b"])
    m = mdl.logistic_regression(x, C=1.0, weight_col=None)
    path = save_model(m, spark, "lr")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    m2 = LogisticRegressionModel.load(path)
    assert list(m2.coefficients) == list(m.coefficients)


def test_a_run_folder_goes_at_its_end(spark, tmp_path):
    import os

    import pytest
    from riskloom.session import run_folder
    from riskloom.sources.sinks import write_table
    df = spark.range(5)
    with run_folder(spark) as folder:
        inner = write_table(df, spark, "t")
        spark.read.parquet(inner).write.parquet(str(tmp_path / "out"))
        assert inner.startswith(folder) and os.path.exists(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and spark.read.parquet(str(tmp_path / "out")).count() == 5
    with pytest.raises(ZeroDivisionError), run_folder(spark) as folder:
        inner = write_table(df, spark, "t")
        1 / 0
    assert spark.read.parquet(inner).count() == 5
    assert not write_table(df, spark, "t").startswith(folder)
