"""D1 stratified split, D2 standardisation, D3 low-variance filter.

Randomness comes only from a hash of (row key, seed), so every result is the
same under any partitioning and after task retries.

Seeded choices follow one total order, (md5(id || seed), id). Exact per-class
selections never rank all rows in one task: the digest prefix gives 65,536
uniform buckets, per-(class, bucket) counts (a table bounded by classes x
65,536 rows) locate the cut, and only the boundary bucket is sorted. Where a
rank per row is needed (folds), rows are ranked inside their (class, bucket)
and offset by the broadcast bucket prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABEL = "is_fraudulent"
ID = "transaction_id"
SEED = 123
HASH_BUCKET_HEX = 4            # 16 bits -> 65,536 buckets per class
# Split shares as exact fractions (15 % test, then 15/85 of the rest).
TEST_SHARE = (15, 100)
VAL_SHARE_OF_REST = (15, 85)


def hash_key(key: str, seed: int) -> "F.Column":
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, part_cols, key: str, seed: int, rank_col: str = "_rank") -> DataFrame:
    """1-based rank of each row inside ``part_cols`` in md5(key || seed) order."""
    part_cols = list(part_cols)
    x = (df.withColumn("_h", hash_key(key, seed))
         .withColumn("_b", F.conv(F.substring("_h", 1, HASH_BUCKET_HEX), 16, 10).cast("int")))
    counts = x.groupBy(*part_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*part_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part_cols, "_b",
                            F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*part_cols, "_b").orderBy("_h", key)
    ranked = x.withColumn("_rn", F.row_number().over(w_in))
    # offsets: at most (#partitions of part_cols) x 65,536 rows -> bounded broadcast;
    # null-safe, so a null group is ranked like any other
    side = offsets.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(part_cols)],
                          F.col("_b").alias("_ob"), "_off")
    cond = F.col("_b") == F.col("_ob")
    for i, c in enumerate(part_cols):
        cond = cond & ranked[c].eqNullSafe(F.col(f"_g{i}"))
    out = ranked.join(F.broadcast(side), cond, "inner").drop("_ob", *[f"_g{i}" for i in range(len(part_cols))])
    return out.withColumn(rank_col, F.col("_off") + F.col("_rn")).drop("_h", "_b", "_rn", "_off")


def _round_share(n: int, share) -> int:
    num, den = share
    return (2 * n * num + den) // (2 * den)    # round half up, integers only


def split_sizes(class_counts: dict, test=TEST_SHARE, val=VAL_SHARE_OF_REST) -> dict:
    sizes = {}
    for c, n in class_counts.items():
        n_test = _round_share(n, test)
        n_val = _round_share(n - n_test, val)
        sizes[c] = (n_test, n_val)
    return sizes


def order_key(key: str, seed: int) -> "F.Column":
    """Total order used for every seeded choice: md5(key || seed) then the key.

    The digest has a fixed width, so comparing ``digest || key`` as strings
    compares (digest, key) lexicographically.
    """
    return F.concat(hash_key(key, seed), F.col(key).cast("string"))


def hash_cuts(df: DataFrame, label: str, key: str, seed: int, targets) -> dict:
    """Order key of the r-th row (1-based) of each class, for ``targets``
    {class: [r, ...]} (or a function of the class counts returning that),
    without ranking all rows.

    Per-(class, bucket) counts (bounded table, kept) give the class totals and
    locate the bucket holding each target rank; only the rows of those few
    boundary buckets are sorted. Two passes over the input in all.
    """
    k = order_key(key, seed)
    x = df.select(F.col(label).alias("_c"), k.alias("_k"),
                  F.conv(F.substring(k, 1, HASH_BUCKET_HEX), 16, 10).cast("int").alias("_b"))
    counts = x.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_n")).persist()
    if callable(targets):
        totals = {r[0]: r[1] for r in counts.groupBy("_c").agg(F.sum("_n")).collect()}
        targets = targets(totals)
    w = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_cum", F.sum("_n").over(w))
    wanted = [(c, r) for c, rs in targets.items() for r in rs if r > 0]
    if not wanted:
        counts.unpersist()
        return {}
    conds = [((F.col("_c") == F.lit(c)) & (F.col("_cum") - F.col("_n") < r) & (F.col("_cum") >= r))
             for c, r in wanted]
    cond = conds[0]
    for cc in conds[1:]:
        cond = cond | cc
    bounds = cum.where(cond).collect()                 # at most len(targets) rows
    loc = {}
    for c, r in wanted:
        for b in bounds:
            if b["_c"] == c and b["_cum"] - b["_n"] < r <= b["_cum"]:
                loc[(c, r)] = (b["_b"], r - (b["_cum"] - b["_n"]))
    buckets = {(c, bb) for (c, _), (bb, _) in loc.items()}
    bcond = None
    for c, bb in buckets:
        t = (F.col("_c") == F.lit(c)) & (F.col("_b") == F.lit(bb))
        bcond = t if bcond is None else (bcond | t)
    wb = Window.partitionBy("_c", "_b").orderBy("_k")
    edge = (x.where(bcond).withColumn("_rn", F.row_number().over(wb)))
    rn_cond = None
    for (c, r), (bb, rr) in loc.items():
        t = (F.col("_c") == F.lit(c)) & (F.col("_b") == F.lit(bb)) & (F.col("_rn") == F.lit(rr))
        rn_cond = t if rn_cond is None else (rn_cond | t)
    got = {(row["_c"], row["_b"], row["_rn"]): row["_k"] for row in edge.where(rn_cond).collect()}
    counts.unpersist()
    return {(c, r): got[(c, bb, rr)] for (c, r), (bb, rr) in loc.items()}


def _class_cond(label: str, c):
    return F.col(label).isNull() if c is None else (F.col(label) == F.lit(c))


def stratified_split(df: DataFrame, label: str = LABEL, key: str = ID, seed: int = SEED,
                     mode: str = "exact") -> DataFrame:
    """Adds ``split`` in {train, val, test}, stratified by ``label``.

    ``exact``: per class exactly round(15 %) test rows and round(15/85 of the
    rest) validation rows, the first ones in (md5(id || seed), id) order. The
    per-class cut keys are found by ``hash_cuts``; assigning the split is then
    a projection (no shuffle of the input). ``hash``: thresholds on the hash
    itself (class shares hold up to binomial error).
    """
    if mode == "hash":
        u = F.conv(F.substring(hash_key(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
        t = TEST_SHARE[0] / TEST_SHARE[1]
        v = (1 - t) * VAL_SHARE_OF_REST[0] / VAL_SHARE_OF_REST[1]
        return df.withColumn("split", F.when(u < t, "test").when(u < t + v, "val").otherwise("train"))
    sizes = {}

    def targets(totals):
        sizes.update(split_sizes(totals))
        return {c: [nt, nt + nv] for c, (nt, nv) in sizes.items()}

    cuts = hash_cuts(df, label, key, seed, targets)
    k = order_key(key, seed)
    split = None
    for c, (nt, nv) in sizes.items():
        cond = _class_cond(label, c)
        t_cut, v_cut = cuts.get((c, nt)), cuts.get((c, nt + nv))
        is_test = (k <= F.lit(t_cut)) if t_cut is not None else F.lit(False)
        is_val = (k <= F.lit(v_cut)) if v_cut is not None else F.lit(False)
        val = F.when(is_test, "test").when(is_val, "val").otherwise("train")
        split = F.when(cond, val) if split is None else split.when(cond, val)
    return df.withColumn("split", split)


def _moments(df: DataFrame, columns):
    """Count, mean and population variance of every column in one pass.

    The columns are assembled into one vector and summarised by Spark ML's
    ``Summarizer`` (a single vector-valued aggregate, instead of a
    hundreds-of-buffers wide aggregate). A column holding nulls falls back to
    its own null-skipping aggregate.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Summarizer
    import math
    cols = list(columns)
    v = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="keep").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    r = v.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("s")) \
        .first()["s"]
    n = int(r["count"])
    out = {}
    for i, c in enumerate(cols):
        m, var = float(r["mean"][i]), float(r["variance"][i])
        if math.isnan(m) or math.isnan(var):
            q = df.agg(F.avg(F.col(c).cast("double")), F.var_pop(F.col(c).cast("double"))).first()
            out[c] = (q[0], q[1])
        else:
            out[c] = (m if n else None, (var * (n - 1) / n) if n > 1 else (0.0 if n == 1 else None))
    return out


def fit_scaler(train: DataFrame, columns) -> dict:
    """D2 fit: mean and population std per column (one vector aggregate)."""
    import math
    mom = _moments(train, columns)
    return {c: (m, None if v is None else math.sqrt(max(v, 0.0))) for c, (m, v) in mom.items()}


def variance_filter_from_scaler(scaler: dict, columns, threshold: float = 0.01,
                                stage: str = "scaled") -> list:
    """D3 without another pass. ``scaled``: the population variance of a
    standardised training column is std^2 / scale^2 (1 for a varying column, 0
    for a constant one, whose scale is 1). ``raw``: the unscaled variance std^2."""
    keep = []
    for c in columns:
        m, s = scaler[c]
        if s is None:
            continue
        scale = 1.0 if (s == 0.0 or stage == "raw") else s
        if (s * s) / (scale * scale) > threshold:
            keep.append(c)
    return keep


def standardize(df: DataFrame, scaler: dict) -> DataFrame:
    """D2 apply: (x - mean) / std; a zero std divides by 1 (as scikit-learn)."""
    new = {}
    for c, (m, s) in scaler.items():
        scale = 1.0 if (s is None or s == 0.0) else s
        new[c] = (F.col(c).cast("double") - F.lit(m if m is not None else 0.0)) / F.lit(scale)
    return df.withColumns(new)


def column_variances(train: DataFrame, columns) -> DataFrame:
    """D3 fit table: population variance of every column (feature, variance)."""
    aggs = [F.var_pop(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]
    wide = train.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance"))
                     for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def variance_filter(train: DataFrame, columns, threshold: float = 0.01) -> list:
    """D3: names of the columns whose population variance exceeds ``threshold``."""
    mom = _moments(train, columns)
    return [c for c in columns if mom[c][1] is not None and mom[c][1] > threshold]
