"""B1 SMOTE, B2 ADASYN, B3 hybrid (SMOTE to a ratio, then undersample).

Synthetic rows are built on the training split only. Every random choice (how
many draws a row gets, which neighbour, the interpolation weight) is a function
of a hash of (row id, draw number, seed), so the output is identical under any
partitioning and after task retries. Interpolation x + u * (nn - x) runs on
array columns (``zip_with``) inside the JVM.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import MAX_BLOCK_ROWS, knn
from .split import hash_rank
from .weights import undersample
from ..session import ensure_checkpoint_dir, scratch_path, shuffles_dropped

SEED = 123
#: Minority rows whose neighbours among all rows are searched at a time: what a search sends is dropped before the next, so the disk
#: holds a round's rows for each block of candidates, and the candidates once.
ROUND_ROWS = MAX_BLOCK_ROWS


def _draw(digits: int, *cols) -> "F.Column":
    """A uniform integer of so many hexadecimal digits from the MD5 of the given columns."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _interpolate(base: DataFrame, neighbours: DataFrame, key: str, vec: str, label: str,
                 draws: "F.Column", k: int, seed: int, minority_label) -> DataFrame:
    """Explode ``draws`` per base row, pick a neighbour and interpolate."""
    nb = (neighbours.groupBy("qid")
          .agg(F.sort_array(F.collect_list(F.struct("rank", "cvec"))).alias("_nbs")))
    x = (base.select(F.col(key).cast("string").alias("_id"), F.col(vec).alias("_x"),
                     draws.alias("_n"))
         .where(F.col("_n") > 0)
         .join(nb, F.col("_id") == F.col("qid"), "inner")
         .withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    of = F.col("_id"), F.col("_d"), F.lit(seed)
    pick = F.pmod(_draw(8, *of, F.lit("nn")), F.size("_nbs"))
    u = _draw(13, *of, F.lit("u")).cast("double") / F.lit(float(1 << 52))
    # through a generator, so that the digests aren't computed again for each component
    x = x.select("*", F.inline(F.array(F.struct((pick + 1).cast("int").alias("_pick"), u.alias("_u")))))
    x = x.withColumn("_nn", F.element_at("_nbs", F.col("_pick"))["cvec"])
    syn = F.zip_with("_x", "_nn", lambda a, b: a + F.col("_u") * (b - a))
    return x.select(F.concat(F.lit("syn-"), F.col("_id"), F.lit("-"), F.col("_d").cast("string"))
                    .alias(key), syn.alias(vec), F.lit(minority_label).alias(label),
                    F.lit(1).alias("synthetic"))


def _classes(df: DataFrame, label: str):
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}   # one row per class
    if len(counts) != 2:
        raise ValueError("resampling needs exactly two classes")
    if min(counts.values()) < 2:
        raise ValueError("resampling needs two or more minority rows: one row has no neighbour of its class")
    minority = min(counts, key=lambda c: counts[c])
    majority = max(counts, key=lambda c: counts[c])
    return counts, minority, majority


def smote(train: DataFrame, key: str, vec: str, label: str, k: int = 5, ratio: float = 1.0,
          seed: int = SEED, keep: bool = False) -> DataFrame:
    """B1: add int(ratio * n_maj) - n_min synthetic minority rows.

    Draws are spread evenly: every minority row gets floor(G / n_min) draws and
    the first G mod n_min rows in hash order one more. ``keep`` checkpoints the
    synthetic rows, for callers that read the result more than once.
    """
    counts, mino, majo = _classes(train, label)
    n_min = counts[mino]
    g = int(ratio * counts[majo]) - n_min
    out = train.select(F.col(key).cast("string").alias(key), vec, label, F.lit(0).alias("synthetic"))
    if g <= 0:
        return out
    minority = train.where(F.col(label) == mino)
    nbrs = knn(minority, minority, k, key, key, vec, with_vectors=True)
    base, extra = divmod(g, n_min)
    ranked = hash_rank(minority, [label], key, seed)
    draws = F.lit(base) + F.when(F.col("_rank") <= extra, 1).otherwise(0)
    syn = _interpolate(ranked, nbrs, key, vec, label, draws, k, seed, mino)
    if keep:
        ensure_checkpoint_dir(train.sparkSession)
        syn = syn.checkpoint(eager=True)
    return out.unionByName(syn)


def adasyn(train: DataFrame, key: str, vec: str, label: str, k: int = 10, ratio: float = 1.0,
           seed: int = SEED, fallback: bool = True) -> DataFrame:
    """B2: synthetic counts proportional to the share of majority neighbours.

    Hardness r_i = majority share among the k nearest rows of the whole training
    set; g_i = round(r_i / sum(r) * G); interpolation uses minority neighbours.
    If no minority row has a majority neighbour, falls back to SMOTE.
    """
    counts, mino, majo = _classes(train, label)
    g = int(ratio * counts[majo]) - counts[mino]
    out = train.select(F.col(key).cast("string").alias(key), vec, label, F.lit(0).alias("synthetic"))
    if g <= 0:
        return out
    minority = train.where(F.col(label) == mino)
    # a share is a number of majority neighbours out of k, so whole numbers say the same; they are
    # read twice, and by far the most work: one number for each minority row
    spark = train.sparkSession
    path, rounds = scratch_path(spark, f"hardness-{uuid.uuid4().hex}"), math.ceil(counts[mino] / ROUND_ROWS)
    for i in range(rounds):
        some = minority.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(rounds)) == i)
        with shuffles_dropped(spark):
            near = knn(some, train, k, key, key, vec, clabel=label)
            near.groupBy("qid").agg(F.count_if(F.col("clabel") != F.lit(float(mino))).alias("_r")).write.mode("append").parquet(path)
    hard = spark.read.parquet(path)
    total = hard.agg(F.sum("_r")).first()[0] or 0
    if total <= 0:
        if fallback:
            return smote(train, key, vec, label, k=5, ratio=ratio, seed=seed)
        raise RuntimeError("no minority row has a majority neighbour")
    draws_tbl = hard.select(F.col("qid").alias("_hid"),
                            F.round(F.col("_r").cast("double") * F.lit(float(g)) / F.lit(float(total)), 0).cast("int")
                            .alias("_draws"))
    base = minority.join(draws_tbl, F.col(key).cast("string") == F.col("_hid"), "inner")
    nbrs = knn(minority, minority, k, key, key, vec, with_vectors=True)
    syn = _interpolate(base, nbrs, key, vec, label, F.col("_draws"), k, seed, mino)
    return out.unionByName(syn)


def hybrid(train: DataFrame, key: str, vec: str, label: str, ratio: float = 0.3,
           under_ratio: float = 0.5, seed: int = SEED) -> DataFrame:
    """SMOTE up to ``ratio`` then undersample the majority to ``under_ratio``.

    A SMOTE ratio above ``under_ratio`` would need more majority rows than exist.
    """
    if ratio > under_ratio:
        raise ValueError("SMOTE ratio must not exceed the undersampling ratio")
    # the counts, the cut and the result read the synthetic rows: made once
    up = smote(train, key, vec, label, ratio=ratio, seed=seed, keep=True)
    return undersample(up, ratio=under_ratio, label=label, key=key, seed=seed)
