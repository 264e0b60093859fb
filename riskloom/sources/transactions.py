"""The transaction scan.

The reference reads one 16-column CSV per dataset version. Here the scan takes
an explicit schema (never inferred), renames the human-readable headers to
snake_case, parses the timestamp as zone-less ``TIMESTAMP_NTZ`` and turns NaN
amounts into nulls so that aggregates skip them the way pandas does.

``fixture_transactions`` builds the same 16 columns from the driver's
``events`` and ``customer`` tables (see FIXTURES.md); ``FIXTURE_TXN_SQL`` is the
identical definition in DuckDB SQL for the oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source header names and their snake_case names, in file order.
SOURCE_HEADERS = [
    ("Transaction ID", "transaction_id"),
    ("Customer ID", "customer_id"),
    ("Transaction Amount", "transaction_amount"),
    ("Transaction Date", "transaction_date"),
    ("Payment Method", "payment_method"),
    ("Product Category", "product_category"),
    ("Quantity", "quantity"),
    ("Customer Age", "customer_age"),
    ("Customer Location", "customer_location"),
    ("Device Used", "device_used"),
    ("IP Address", "ip_address"),
    ("Shipping Address", "shipping_address"),
    ("Billing Address", "billing_address"),
    ("Is Fraudulent", "is_fraudulent"),
    ("Account Age Days", "account_age_days"),
    ("Transaction Hour", "transaction_hour"),
]

_TYPES = {
    "transaction_amount": T.DoubleType(),
    "transaction_date": T.TimestampNTZType(),
    "quantity": T.IntegerType(),
    "customer_age": T.IntegerType(),
    "is_fraudulent": T.IntegerType(),
    "account_age_days": T.IntegerType(),
    "transaction_hour": T.IntegerType(),
}

TXN_SCHEMA = T.StructType([
    T.StructField(name, _TYPES.get(name, T.StringType()), True)
    for _, name in SOURCE_HEADERS
])

# Dataset versions and their file names.
VERSION_FILES = {
    "v1": "Fraudulent_E-Commerce_Transaction_Data.csv",
    "v2": "Fraudulent_E-Commerce_Transaction_Data_2.csv",
}


def _tolerant(name: str, kind: T.DataType, source: T.DataType):
    """One rule for text fields: what is no value of the field's type is null.

    An integer field takes any spelling of a whole number ("1", "1.0", "1e0").
    """
    c = F.col(name)
    if isinstance(source, T.StringType) and isinstance(kind, T.NumericType):
        number = F.trim(c).try_cast("double")
        if isinstance(kind, T.IntegralType):
            number = F.when(number == F.floor(number), number)
        return number.try_cast(kind)
    return c.cast(kind)


def rejected_fields(raw: DataFrame) -> DataFrame:
    """Per numeric or date field of a text scan, how many values are given but unusable (column_name, n_rejected)."""
    aggs = {}
    for field in TXN_SCHEMA.fields:
        if field.name in raw.columns and isinstance(raw.schema[field.name].dataType, T.StringType) \
                and not isinstance(field.dataType, T.StringType):
            used = (F.try_to_timestamp(F.col(field.name)) if isinstance(field.dataType, T.TimestampNTZType)
                    else _tolerant(field.name, field.dataType, T.StringType()))
            given = F.trim(F.col(field.name)) != ""
            aggs[field.name] = F.count_if(given & used.isNull())
    row = raw.agg(*[a.alias(c) for c, a in aggs.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_rejected")) for c in aggs])))


TEXT_SCHEMA = T.StructType([T.StructField(h, T.StringType(), True) for h, _ in SOURCE_HEADERS])


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """The CSV files' fields as text, under the snake_case names."""
    return _named(spark.read.schema(TEXT_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path))


def _named(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.col(f"`{h}`").alias(n) for h, n in SOURCE_HEADERS])


def from_text(fields: DataFrame) -> DataFrame:
    """Typed transactions of a batch or stream of text fields, by one rule."""
    return _normalise(fields.withColumn("transaction_date", F.try_to_timestamp("transaction_date").cast("timestamp_ntz")))


def _normalise(df: DataFrame) -> DataFrame:
    """Cast to TXN_SCHEMA and map NaN amounts to null."""
    cols = []
    for field in TXN_SCHEMA.fields:
        c = _tolerant(field.name, field.dataType, df.schema[field.name].dataType)
        if isinstance(field.dataType, T.DoubleType):
            c = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def read_transactions(spark: SparkSession, path: str,
                      fmt: str = "csv") -> DataFrame:
    """Scan a transaction file set with the explicit 16-column schema.

    CSV files carry the source headers; they are read as strings with a fixed
    schema (no inference pass) and cast; an unusable value is null and counted by
    ``rejected_fields(scan_text(...))``. Parquet files may use either the
    source headers or the snake_case names.
    """
    if fmt == "csv":
        return from_text(scan_text(spark, path))
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        mapping = {h: n for h, n in SOURCE_HEADERS}
        raw = raw.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in raw.columns])
        return _normalise(raw)
    raise ValueError(f"unsupported format: {fmt}")


def load_version(spark: SparkSession, version: str, base_dir: str) -> DataFrame:
    """Pick a dataset version ('v1' or 'v2') under ``base_dir``."""
    key = version.lower()
    if key not in VERSION_FILES:
        raise ValueError("Version must be 'v1' or 'v2'")
    return read_transactions(spark, os.path.join(base_dir, VERSION_FILES[key]), "csv")


def fixture_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `txn` fixture: 16 transaction columns derived from events + customer."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = (spark.read.parquet(f"{sf_dir}/customer.parquet")
         .select("c_custkey", "c_nationkey"))
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = e.withColumn("_k", k)
    kk = F.col("_k")
    j = e.join(c, e.user_id == c.c_custkey, "left")

    def case(mod, labels):
        expr = None
        for i, lab in enumerate(labels[:-1]):
            cond = (kk % mod) == i
            expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
        return expr.otherwise(labels[-1])

    # Fixture level lists (FIXTURES.md §1).
    payment = ["PayPal", "bank transfer", "credit card", "debit card"]
    category = ["clothing", "electronics", "health & beauty", "home & garden", "toys & games"]
    device = ["desktop", "mobile", "tablet"]
    uid = F.col("user_id")
    return j.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        uid.cast("string").alias("customer_id"),
        F.col("value").alias("transaction_amount"),
        F.col("ts").cast("timestamp_ntz").alias("transaction_date"),
        case(4, payment).alias("payment_method"),
        case(5, category).alias("product_category"),
        (F.lit(1) + kk % 7).alias("quantity"),
        (F.lit(18) + (uid * 7) % 60).cast("int").alias("customer_age"),
        F.concat(F.lit("L"), F.col("c_nationkey").cast("string")).alias("customer_location"),
        case(3, device).alias("device_used"),
        F.concat(F.lit("10.0.0."), kk.cast("string")).alias("ip_address"),
        F.concat(F.lit("A"), uid.cast("string")).alias("shipping_address"),
        F.concat(F.lit("A"), (uid + F.when(kk % 10 == 0, 1).otherwise(0)).cast("string"))
        .alias("billing_address"),
        F.when((F.col("event_type") == "error") & (kk < 25), 1).otherwise(0)
        .alias("is_fraudulent"),
        ((uid * 13 + F.col("event_id")) % 400).cast("int").alias("account_age_days"),
        F.hour("ts").cast("int").alias("transaction_hour"),
    )


# The same fixture for DuckDB (views `events`, `customer` are pre-registered).
FIXTURE_TXN_SQL = """
SELECT
  CAST(e.event_id AS VARCHAR) AS transaction_id,
  CAST(e.user_id AS VARCHAR) AS customer_id,
  e.value AS transaction_amount,
  e.ts AS transaction_date,
  CASE e.k % 4 WHEN 0 THEN 'PayPal' WHEN 1 THEN 'bank transfer'
               WHEN 2 THEN 'credit card' ELSE 'debit card' END AS payment_method,
  CASE e.k % 5 WHEN 0 THEN 'clothing' WHEN 1 THEN 'electronics'
               WHEN 2 THEN 'health & beauty' WHEN 3 THEN 'home & garden'
               ELSE 'toys & games' END AS product_category,
  CAST(1 + e.k % 7 AS INTEGER) AS quantity,
  CAST(18 + (e.user_id * 7) % 60 AS INTEGER) AS customer_age,
  'L' || CAST(c.c_nationkey AS VARCHAR) AS customer_location,
  CASE e.k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_used,
  '10.0.0.' || CAST(e.k AS VARCHAR) AS ip_address,
  'A' || CAST(e.user_id AS VARCHAR) AS shipping_address,
  'A' || CAST(e.user_id + CASE WHEN e.k % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS billing_address,
  CAST(CASE WHEN e.event_type = 'error' AND e.k < 25 THEN 1 ELSE 0 END AS INTEGER) AS is_fraudulent,
  CAST((e.user_id * 13 + e.event_id) % 400 AS INTEGER) AS account_age_days,
  CAST(hour(e.ts) AS INTEGER) AS transaction_hour
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events) e
LEFT JOIN customer c ON e.user_id = c.c_custkey
"""

# The fixture with gaps and one customer of a third of all rows: every so many event ids, a column is null.
GAPS = {"transaction_amount": 17, "quantity": 19, "customer_age": 23, "payment_method": 29, "customer_location": 31,
        "account_age_days": 41, "product_category": 13, "shipping_address": 47}
HOT_EVERY, NO_CUSTOMER_EVERY = 3, 37


def fixture_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `txn` fixture with null cells, rows without a customer, and customer 'hot' on every third event."""
    i = F.col("transaction_id").cast("long")
    customer = F.when(i % NO_CUSTOMER_EVERY == 0, None).when(i % HOT_EVERY == 0, "hot").otherwise(F.col("customer_id"))
    gaps = {c: F.when(i % n != 0, F.col(c)) for c, n in GAPS.items()}
    return fixture_transactions(spark, sf_dir).withColumns({"customer_id": customer, **gaps})


_I = "CAST(transaction_id AS BIGINT)"
FIXTURE_GAPS_SQL = f"""
SELECT * REPLACE (
  CASE WHEN {_I} % {NO_CUSTOMER_EVERY} = 0 THEN NULL WHEN {_I} % {HOT_EVERY} = 0 THEN 'hot' ELSE customer_id END AS customer_id,
  {', '.join(f'CASE WHEN {_I} % {n} <> 0 THEN {c} END AS {c}' for c, n in GAPS.items())})
FROM ({FIXTURE_TXN_SQL})
"""
