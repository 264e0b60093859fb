"""Rules that do not depend on the size of the data: null scores, nulls in groups, collisions, large amounts."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from riskloom.operators import balance, evaluate, features, location, models, prepare, split
from riskloom.sources import transactions


def test_null_scores_take_no_part_whatever_the_ranges(spark):
    rows = [(i, i % 2, "m", s) for i, s in enumerate([0.1, 0.4, 0.35, 0.8, None, float("nan"), 0.8])]
    scores = spark.createDataFrame(rows, "row_id int, label int, model string, proba double")
    key = lambda df: sorted(tuple(r) for r in df.select("model", "proba", "pos", "neg", "cum_pos", "cum_neg", "P", "N").collect())
    one, three = (key(evaluate.score_counts(scores, n_ranges=n)) for n in (1, 3))
    assert one == three and len(one) == 4 and {r[-2:] for r in one} == {(2, 3)}


def test_tree_depth_limit_is_an_error(spark):
    df = spark.createDataFrame([(0.0,)], "label double")
    for fit in (models.random_forest, models.boosted_trees):
        with pytest.raises(ValueError, match="30"):
            fit(df, max_depth=40)


def test_grids_have_all_points():
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    assert len(models.lr_grid(LogisticRegression(), 10.0)) == 12
    assert len(models.gbt_grid(GBTClassifier())) == 108
    assert len(models.rf_grid(RandomForestClassifier())) == 16


def test_one_hot_keeps_levels_whose_names_collide(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["Alpha", "PayPal", "paypal", "pay-pal", None])], "transaction_id int, payment_method string")
    kept = prepare.fit_one_hot(df, ["payment_method"])
    out = prepare.one_hot(df, kept)
    assert len(out.columns) == 4 and [sum(r[1:]) for r in sorted(out.collect())] == [0, 1, 1, 1, 0]
    with pytest.raises(ValueError, match="max_levels = 3"):
        prepare.fit_one_hot(df, ["payment_method"], max_levels=3)
    assert len(prepare.fit_one_hot(df, ["payment_method"], max_levels=4)["payment_method"]) == 3


def test_train_only_imputation_fits_columns_without_nulls(spark):
    fit_rows = spark.createDataFrame([(1, 0, 5.0, "a"), (2, 0, 7.0, "a"), (3, 1, 9.0, "b")], "transaction_id int, is_fraudulent int, customer_age double, device_used string")
    other = spark.createDataFrame([(4, 0, None, None)], fit_rows.schema)
    (row,) = prepare.impute(other, prepare.fit_imputer(fit_rows, every_column=True)).collect()
    assert row.customer_age == 7.0 and row.device_used == "a"


def test_ranks_of_a_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, g string")
    assert sorted((r.g is None, r._rank) for r in split.hash_rank(df, ["g"], "id", 1).collect()) == [(False, 1), (True, 1), (True, 2)]


def test_a_single_minority_row_is_a_clear_error(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [2.0], 1)], "row_id int, v array<double>, label int")
    with pytest.raises(ValueError, match="two or more minority rows"):
        balance.smote(df, "row_id", "v", "label")


def test_lookup_beyond_the_broadcast_bound(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 2 else f"k{i % 31}") for i in range(3000)], "i int, k string").repartition(4)
    table = spark.createDataFrame([("hot", 1.0, None)] + [(f"k{i}", float(i), "x") for i in range(20)], "k string, v double, w string")
    want = sorted(map(str, rows.join(table, "k", "left").select("i", "k", "v", "w").collect()))
    for bound in (1 << 20, 0):
        got = location.lookup_join(rows, table, "k", max_broadcast_bytes=bound)
        assert sorted(map(str, got.select("i", "k", "v", "w").collect())) == want


def test_tolerant_csv_numbers(spark, tmp_path):
    headers = [h for h, _ in transactions.SOURCE_HEADERS]
    names = [n for _, n in transactions.SOURCE_HEADERS]

    def line(**values):
        base = {n: "" for n in names} | {"transaction_id": "t", "quantity": "2", "transaction_amount": "1.5", "is_fraudulent": "0"}
        return ",".join((base | values)[n] for n in names)

    lines = [line(quantity="1.0"), line(quantity="3"), line(quantity="1.5"), line(quantity="many", transaction_amount="x"), line(quantity=" 4 "), line(transaction_date="no date")]
    (tmp_path / "t.csv").write_text("\n".join([",".join(headers), *lines]) + "\n")
    got = transactions.read_transactions(spark, str(tmp_path)).collect()
    assert [r.quantity for r in got] == [1, 3, None, None, 4, 2] and got[3].transaction_amount is None
    counts = {r.column_name: r.n_rejected for r in transactions.rejected_fields(transactions.scan_text(spark, str(tmp_path))).collect()}
    assert counts["quantity"] == 2 and counts["transaction_amount"] == 1 and counts["transaction_date"] == 1 and counts["is_fraudulent"] == 0


@pytest.mark.parametrize("chunk_rows", [10_000, 100])
def test_past_deviation_of_large_amounts(spark, chunk_rows):
    amounts = [1e8 + (i * 37 % 100) / 100 for i in range(600)]
    start = dt.datetime(2024, 1, 1)
    rows = [(f"t{i:04d}", "c1", start + dt.timedelta(hours=i), a, "cat") for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, transaction_date timestamp_ntz, transaction_amount double, product_category string")
    got = {r.transaction_id: r.past_std_customer_transaction for r in features.past_customer_features(df, chunk_rows=chunk_rows).collect()}
    for i in (1, 99, 100, 350, 599):
        assert math.isclose(got[f"t{i:04d}"], statistics.stdev(amounts[:i + 1]), rel_tol=1e-6)
    assert got["t0000"] is None


def test_checkpoint_folder_rules(spark, monkeypatch):
    from riskloom import session

    class Context:
        master, set_to = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.set_to

        def setCheckpointDir(self, path):
            self.set_to = f"file:{path}/some-id"

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, conf=None, folder=None):
            self.conf, self.sparkContext = Conf(conf or {}), Context()
            self.sparkContext.set_to = folder

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    assert session.ensure_checkpoint_dir(Session(folder="hdfs:/own")) == "hdfs:/own"
    named = Session({"spark.checkpoint.dir": "/shared"})
    assert session.ensure_checkpoint_dir(named) == "/shared" and named.sparkContext.set_to == "file:/shared/some-id"


@pytest.mark.parametrize("history", ["all", "past"])
def test_rows_without_a_customer_are_spread(spark, history):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"t{i:04d}", None if i % 2 else "c1", start + dt.timedelta(hours=i), float(i), "cat") for i in range(200)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, transaction_date timestamp_ntz, transaction_amount double, product_category string")
    if history == "past":
        df = df.withColumn("_first_id", F.lit(1))
    out = features.history_features(df, features.customer_table(df), history=history)
    got = {r.transaction_id: r for r in out.collect()}
    assert len(got) == 200
    for i in range(1, 200, 2):
        r = got[f"t{i:04d}"]
        assert r.time_since_last_transaction == 0.0 and r.avg_customer_transaction is None and r.amount_deviation_from_history is None
    assert got["t0010"].time_since_last_transaction == 2.0
