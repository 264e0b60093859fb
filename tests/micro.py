"""Hand-written micro tables for the reference's edge cases."""

import datetime as dt

from riskloom.sources.transactions import TXN_SCHEMA

BASE = dict(transaction_id="t", customer_id="c1", transaction_amount=10.0,
            transaction_date=dt.datetime(2024, 1, 1, 12, 0, 0), payment_method="PayPal",
            product_category="clothing", quantity=1, customer_age=30, customer_location="L1",
            device_used="mobile", ip_address="10.0.0.1", shipping_address="A1",
            billing_address="A1", is_fraudulent=0, account_age_days=100, transaction_hour=12)


def rows(spark, changes):
    data = []
    for i, ch in enumerate(changes):
        r = dict(BASE)
        r["transaction_id"] = f"t{i:03d}"
        r.update(ch)
        data.append(tuple(r[f.name] for f in TXN_SCHEMA.fields))
    return spark.createDataFrame(data, TXN_SCHEMA)


def ts(*a):
    return dt.datetime(*a)
