"""Reference traps on hand-written micro tables."""

import math

import pytest

from riskloom.operators import features as feat

from .micro import rows, ts


def _by_id(df, *cols):
    return {r["transaction_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_bin_edges_are_right_closed(spark):
    hours = [0, 5, 6, 12, 18, 22, 23]
    df = rows(spark, [dict(transaction_hour=h) for h in hours])
    got = _by_id(feat.row_features(df), "transaction_hour", "hour_bin", "unusual_hour_flag")
    want = {0: ("Night", 1), 5: ("Night", 1), 6: ("Night", 0), 12: ("Morning", 0),
            18: ("Afternoon", 0), 22: ("Evening", 0), 23: ("Evening", 1)}
    for h, b, u in got.values():
        assert (b, u) == want[h]


def test_age_bins_and_account_flags(spark):
    ages = [0, 25, 35, 50, 65, 66]
    df = rows(spark, [dict(customer_age=a) for a in ages]
              + [dict(account_age_days=29), dict(account_age_days=30), dict(account_age_days=-1)])
    out = feat.row_features(df).collect()
    cat = {r["customer_age"]: r["age_category"] for r in out[:6]}
    assert cat == {0: None, 25: "Young", 35: "Young_Adult", 50: "Adult", 65: "Senior", 66: "Elder"}
    acc = {r["account_age_days"]: (r["new_account"], r["account_age_weeks"]) for r in out[6:]}
    assert acc == {29: (1, 4), 30: (0, 4), -1: (1, -1)}


def test_monday_is_zero_and_weekend(spark):
    df = rows(spark, [dict(transaction_date=ts(2024, 1, 1, 9)),    # Monday
                      dict(transaction_date=ts(2024, 1, 6, 9)),    # Saturday
                      dict(transaction_date=ts(2024, 1, 7, 9))])   # Sunday
    got = sorted((r["day_of_week"], r["is_weekend"]) for r in feat.row_features(df).collect())
    assert got == [(0, 0), (5, 1), (6, 1)]


def test_address_mismatch_null_counts_as_mismatch(spark):
    df = rows(spark, [dict(shipping_address=None, billing_address=None),
                      dict(shipping_address="A", billing_address=None),
                      dict(shipping_address="A", billing_address="A"),
                      dict(shipping_address="A", billing_address="B")])
    got = [r["address_mismatch"] for r in feat.row_features(df).orderBy("transaction_id").collect()]
    assert got == [1, 1, 0, 1]


def test_single_row_customer_and_microsecond_gap(spark):
    df = rows(spark, [dict(customer_id="solo"),
                      dict(customer_id="m", transaction_date=ts(2024, 1, 1, 0, 0, 0, 0)),
                      dict(customer_id="m", transaction_date=ts(2024, 1, 1, 0, 0, 0, 1))])
    out = {r["transaction_id"]: r for r in feat.feature_table(df).collect()}
    solo = out["t000"]
    assert solo["time_since_last_transaction"] == 0.0
    assert solo["std_customer_transaction"] is None          # sample std of one row
    assert solo["amount_deviation_from_history"] == 0.0
    assert out["t002"]["time_since_last_transaction"] == pytest.approx(1 / 3.6e9)


def test_rolling_mean_skips_nulls(spark):
    amounts = [10.0, 20.0, None, 40.0, 50.0, 60.0, 70.0]
    df = rows(spark, [dict(transaction_amount=a, transaction_date=ts(2024, 1, 1 + i))
                      for i, a in enumerate(amounts)])
    out = feat.feature_table(df).orderBy("transaction_date").collect()
    rolling = [10, 15, 15, (10 + 20 + 40) / 3, 30, 42.5, 55]
    for r, a, m in zip(out, amounts, rolling):
        dev = r["amount_deviation_from_history"]
        if a is None:
            assert dev is None
        else:
            assert dev == pytest.approx((a - m) / (m + 1))


def test_null_customer_gets_no_history(spark):
    df = rows(spark, [dict(customer_id=None), dict(customer_id=None, transaction_date=ts(2024, 2, 1))])
    for r in feat.feature_table(df).collect():
        assert r["time_since_last_transaction"] == 0.0
        assert r["amount_deviation_from_history"] is None
        assert r["total_customer_transactions"] is None
        assert r["avg_daily_transaction_velocity"] is None


def test_velocity_counts_active_days_only(spark):
    df = rows(spark, [dict(transaction_date=ts(2024, 1, 1, 1)), dict(transaction_date=ts(2024, 1, 1, 2)),
                      dict(transaction_date=ts(2024, 1, 1, 3)), dict(transaction_date=ts(2024, 1, 9, 3))])
    v = {r["avg_daily_transaction_velocity"] for r in feat.feature_table(df).collect()}
    assert v == {2.0}


def test_quintiles_with_duplicate_edges_leave_bins_empty(spark):
    df = rows(spark, [dict(transaction_amount=5.0)] * 8 + [dict(transaction_amount=9.0)] * 2)
    st = feat.fit_global_stats(df)
    got = {r["transaction_size"] for r in feat.stat_features(df, st).collect()}
    assert got <= {"Very_Small", "Large", "Very_Large"}
    assert "Very_Small" in got


def test_constant_amount_has_null_zscore(spark):
    df = rows(spark, [dict(transaction_amount=3.0)] * 3)
    st = feat.fit_global_stats(df)
    assert st.amount_std_pop == 0.0
    assert all(r["amount_zscore"] is None for r in feat.stat_features(df, st).collect())
    assert math.isclose(st.amount_q95, 3.0)
