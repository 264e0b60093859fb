"""The `scores` fixture: deterministic per-model probabilities (no training).

Long table ``(row_id, label, model, proba)`` derived from the transaction
fixture, so its size grows with the driver's tables. Integer arithmetic and a
single division keep the values bit-identical across engines.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transactions import fixture_transactions, FIXTURE_TXN_SQL

# Model names and their multipliers (FIXTURES.md §2).
SCORE_MULTIPLIERS = [("lr", 7919), ("rf", 104729), ("nn", 1299709), ("gbt", 15485863)]


def scores_from_transactions(txn: DataFrame) -> DataFrame:
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(m).cast("bigint").alias("mult"))
                       for n, m in SCORE_MULTIPLIERS])
    x = txn.select(F.col("transaction_id").alias("row_id"),
                   F.col("is_fraudulent").alias("label"),
                   F.explode(models).alias("_m"))
    v = (F.col("row_id").cast("bigint") * F.col("_m.mult")) % 1000
    proba = (F.when(F.col("label") == 1, (F.lit(2000) + F.lit(7) * v).cast("double") / F.lit(1e4))
             .otherwise((v * v * v).cast("double") / F.lit(1.1e9)))
    return x.select("row_id", "label", F.col("_m.model").alias("model"), proba.alias("proba"))


def fixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_from_transactions(fixture_transactions(spark, sf_dir))


FIXTURE_SCORES_SQL = f"""
SELECT t.transaction_id AS row_id, t.is_fraudulent AS label, m.model,
  CASE WHEN t.is_fraudulent = 1
       THEN CAST(2000 + 7 * ((CAST(t.transaction_id AS BIGINT) * m.mult) % 1000) AS DOUBLE) / 1e4
       ELSE CAST(((CAST(t.transaction_id AS BIGINT) * m.mult) % 1000)
               * ((CAST(t.transaction_id AS BIGINT) * m.mult) % 1000)
               * ((CAST(t.transaction_id AS BIGINT) * m.mult) % 1000) AS DOUBLE) / 1.1e9
  END AS proba
FROM ({FIXTURE_TXN_SQL}) t
CROSS JOIN (VALUES {", ".join(f"('{n}', CAST({m} AS BIGINT))" for n, m in SCORE_MULTIPLIERS)}) AS m(model, mult)
"""


#: A linear scorer that every engine can state: each coefficient hashes its feature's name.
FIXED_INTERCEPT = -0.35


def fixed_coefficient(name: str) -> float:
    return (int(hashlib.md5(name.encode()).hexdigest()[:4], 16) % 21 - 10) / 10
