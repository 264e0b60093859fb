"""Feature derivation: F2-F17, A1-A7, J1/J2, W1-W3, I1-I7.

Plan shape (one logical plan, no driver loops):

* ``fit_global_stats`` is one global aggregate (mean, population std and exact
  quantiles of the amount, p95 of the quantity). Its single result row is a
  handful of scalars, inlined as literals, so applying it is a projection.
* ``customer_table`` is a partially aggregated ``groupBy(customer_id)``; the
  distinct transaction count is planned by Catalyst with the distinct key in
  the shuffle key, so a hot customer does not land in one task. Daily velocity
  (A7) is a two-level aggregate (customer, date) -> customer.
* History features (W1-W3) and the aggregates as of each row need each
  customer's rows in time order. They are one prefix scan over ordered parts
  (``scan.ordered_parts``): a customer of up to ``chunk_rows`` rows is one
  part, the rows of larger ones are range-partitioned by (customer, time, id),
  so that neither a customer nor a burst of equal timestamps stays in one task.
  Each part gets the four rows before it (enough for the lag and the 5-row
  rolling mean) and, for running aggregates, the totals of the parts before it.
"""

from __future__ import annotations

from dataclasses import dataclass, asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import (flag, address_mismatch, hour_bin, age_category,
                                     account_age_weeks, transaction_size, safe_div)
from .quantiles import exact_quantiles
from .scan import CHUNK, HALO, Parts, carry, ordered_parts

TS = "transaction_date"
AMT = "transaction_amount"
CUST = "customer_id"
TID = "transaction_id"

# Rows above which one customer's history is split into ordered parts.
DEFAULT_CHUNK_ROWS = 500_000
# Rows of history the windows look back (rolling mean of 5 including the current).
ROLLING_ROWS = 5
HALO_ROWS = ROLLING_ROWS - 1


@dataclass(frozen=True)
class GlobalStats:
    """A1: global statistics row (scalars only)."""
    amount_mean: float | None
    amount_std_pop: float | None
    amount_q20: float | None
    amount_q40: float | None
    amount_q60: float | None
    amount_q80: float | None
    amount_q95: float | None
    quantity_q95: float | None
    n_rows: int | None = None

    def as_dict(self):
        return asdict(self)


def global_stats_frame(df: DataFrame, approx: bool = False, accuracy: int = 100_000,
                       with_count: bool = False) -> DataFrame:
    """A1 as a one-row DataFrame.

    Quantiles are exact by bracketing (``quantiles.exact_quantiles``);
    ``approx=True`` uses ``percentile_approx`` with rank error ``1/accuracy``.
    """
    probs = [0.2, 0.4, 0.6, 0.8, 0.95]
    amt, qty = F.col(AMT), F.col("quantity").cast("double")
    if approx:
        qa = F.percentile_approx(amt, probs, accuracy)
        qq = F.percentile_approx(qty, 0.95, accuracy).cast("double")
    else:
        q = exact_quantiles(df, {"a": amt, "q": qty}, probs)
        qa, qq = F.array(*[F.lit(v).cast("double") for v in q["a"]]), F.lit(q["q"][-1]).cast("double")
    stats = [F.avg(amt).alias("amount_mean"), F.stddev_pop(amt).alias("amount_std_pop"), F.count(F.lit(1)).alias("n_rows")]
    row = (df.agg(*stats, qa.alias("_qa"), qq.alias("quantity_q95")) if approx
           else df.agg(*stats).withColumns({"_qa": qa, "quantity_q95": qq}))
    return row.select(
        "amount_mean", "amount_std_pop",
        *[F.col("_qa")[i].cast("double").alias(n) for i, n in
          enumerate(["amount_q20", "amount_q40", "amount_q60", "amount_q80", "amount_q95"])],
        F.col("quantity_q95").cast("double").alias("quantity_q95"),
        *(["n_rows"] if with_count else []))


def fit_global_stats(df: DataFrame, approx: bool = False) -> GlobalStats:
    r = global_stats_frame(df, approx=approx, with_count=True).first()
    return GlobalStats(**r.asDict())


def row_features(df: DataFrame) -> DataFrame:
    """Per-row projections, no statistics needed."""
    ts, hour = F.col(TS), F.col("transaction_hour")
    dow = F.weekday(ts)
    return df.withColumns({
        "address_mismatch": address_mismatch(),
        "day_of_week": dow,
        "month": F.month(ts),
        "is_weekend": flag(dow >= 5),
        "new_account": flag(F.col("account_age_days") < 30),
        "amount_log": F.log1p(F.col(AMT)),
        "amount_per_quantity": safe_div(F.col(AMT), F.col("quantity") + 1),
        "hour_bin": hour_bin(hour),
        "age_category": age_category(F.col("customer_age")),
        "account_age_weeks": account_age_weeks(F.col("account_age_days")),
        "quantity_log": F.log1p(F.col("quantity").cast("double")),
        "unusual_hour_flag": flag((hour < 6) | (hour > 22)),
    })


def stat_features(df: DataFrame, stats: GlobalStats) -> DataFrame:
    """F9, F13, F15, F16 from a fitted A1 row (literals, so a pure projection)."""
    amt, qty = F.col(AMT), F.col("quantity")
    lit = lambda v: F.lit(v).cast("double")
    return df.withColumns({
        "amount_zscore": safe_div(amt - lit(stats.amount_mean), lit(stats.amount_std_pop)),
        "transaction_size": transaction_size(amt, stats.amount_q20, stats.amount_q40,
                                             stats.amount_q60, stats.amount_q80),
        "high_amount_flag": flag(amt > lit(stats.amount_q95)),
        "high_quantity_flag": flag(qty > lit(stats.quantity_q95)),
    })


def daily_counts(df: DataFrame) -> DataFrame:
    """Rows per (customer, calendar date); null keys dropped as pandas does."""
    return (df.where(F.col(CUST).isNotNull() & F.col(TS).isNotNull())
            .groupBy(CUST, F.to_date(TS).alias("transaction_day"))
            .agg(F.count(F.lit(1)).alias("daily_count")))


def daily_velocity(df: DataFrame) -> DataFrame:
    """Mean of the daily counts over active days only."""
    return (daily_counts(df).groupBy(CUST)
            .agg(F.avg(F.col("daily_count").cast("double")).alias("avg_daily_transaction_velocity")))


def customer_aggregates(df: DataFrame, with_velocity: bool = False) -> DataFrame:
    """A2-A4 (and A7) plus the row count, which plans the history parts.

    One aggregate with plain and distinct counts: Catalyst deals the rows of
    each distinct column by (customer, value), merged map-side, so no task
    holds a whole hot customer and no buffer holds a set. A7 = rows with a
    date / distinct dates = the mean of the daily counts over active days.
    """
    aggs = [F.countDistinct(TID).alias("total_customer_transactions"),
            F.avg(AMT).alias("avg_customer_transaction"),
            F.stddev_samp(AMT).alias("std_customer_transaction"),
            F.max(AMT).alias("max_customer_transaction"),
            F.countDistinct("product_category").alias("product_category_diversity"),
            F.count(F.lit(1)).alias("_n_rows")]
    if with_velocity:
        aggs.append(F.try_divide(F.count(TS).cast("double"), F.countDistinct(F.to_date(TS)).cast("double"))
                    .alias("avg_daily_transaction_velocity"))
    return df.where(F.col(CUST).isNotNull()).groupBy(CUST).agg(*aggs)


def customer_table(df: DataFrame) -> DataFrame:
    """A2-A4 and A7 as one customer-level table (one row per key, one aggregate)."""
    return customer_aggregates(df, with_velocity=True)


CUSTOMER_COLUMNS = ["total_customer_transactions", "avg_customer_transaction",
                    "std_customer_transaction", "max_customer_transaction",
                    "product_category_diversity", "avg_daily_transaction_velocity"]


def _order():
    return [F.col(TS).asc_nulls_last(), F.col(TID).asc_nulls_last()]


def _first_ids(df: DataFrame) -> DataFrame:
    """A transaction id counts once, at its first occurrence for the customer."""
    return df.withColumn("_first_id", (F.row_number().over(Window.partitionBy(CUST, TID).orderBy(*_order())) == 1).cast("long"))


def _as_of(parts: Parts) -> DataFrame:
    """A2-A4 and A7 as of each row (CUSTOMER_COLUMNS), on ordered parts with _first_id.

    Running aggregates inside a part skip the rows before it, which only tell
    whether its first row starts a new day; the totals of the parts before it
    are carried in. Exact decimal sums keep the results independent of the cuts.
    """
    real, amt, day = F.col(HALO) == 0, F.col(AMT), F.to_date(TS)
    w = Window.partitionBy(CUST, CHUNK).orderBy(*_order())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    new_day = (F.when(day.isNull(), 0)
               .when(F.coalesce(F.lag(day).over(w) != day, F.lit(True)), 1).otherwise(0))
    x = parts.rows.withColumn("_dec", F.when(real, amt).cast("decimal(38,10)")).withColumn("_new_day", F.when(real, new_day).cast("long"))
    own = {c: F.when(real, F.col(c)) for c in (AMT, TS, "product_category", "_first_id")}
    x = x.withColumns({"_r_ids": F.sum(own["_first_id"]).over(run), "_r_n": F.count(own[AMT]).over(run),
                       "_r_s": F.sum("_dec").over(run), "_r_mean": F.avg(own[AMT]).over(run),
                       "_r_m2": F.var_pop(own[AMT]).over(run) * F.count(own[AMT]).over(run),
                       "_r_max": F.max(own[AMT]).over(run), "_r_cats": F.collect_set(own["product_category"]).over(run),
                       "_r_dated": F.count(own[TS]).over(run), "_r_days": F.sum("_new_day").over(run)})
    totals = {"ids": F.sum("_first_id"), "n": F.count(amt), "s": F.sum("_dec"), "mean": F.avg(amt),
              "m2": F.var_pop(amt) * F.count(amt), "max": F.max(amt), "cats": F.collect_set("product_category"),
              "dated": F.count(TS), "days": F.sum("_new_day")}
    if parts.borders is None:  # every customer is one part: nothing comes before
        types = {"s": "decimal(38,10)", "mean": "double", "m2": "double", "max": "double", "cats": "array<string>"}
        y = x.withColumns({f"_p_{c}": F.lit(None).cast(types.get(c, "long")) for c in totals})
    else:  # a row for each border: within the bound of the parts
        split = x.where(real).join(F.broadcast(parts.borders), [CUST, CHUNK], "left_semi")
        y = x.join(F.broadcast(carry(split, CUST, totals)), [CUST, CHUNK], "left")
    zero = F.lit(0).cast("long")
    both = lambda c: F.coalesce(f"_p_{c}", zero) + F.coalesce(f"_r_{c}", zero)
    n = both("n")
    ssum = F.coalesce("_p_s", F.lit(0).cast("decimal(38,10)")) + F.coalesce("_r_s", F.lit(0).cast("decimal(38,10)"))
    # moments of the parts before and of the running rows, merged pairwise
    a, b = F.coalesce("_p_n", zero).cast("double"), F.coalesce("_r_n", zero).cast("double")
    gap = F.coalesce(F.col("_p_mean") - F.col("_r_mean"), F.lit(0.0))
    m2 = F.coalesce("_p_m2", F.lit(0.0)) + F.coalesce("_r_m2", F.lit(0.0)) + F.coalesce(F.try_divide(a * b, a + b), F.lit(0.0)) * gap * gap
    cats = F.array_distinct(F.concat(F.coalesce("_p_cats", F.array().cast("array<string>")), "_r_cats"))
    has = F.col(CUST).isNotNull()
    y = y.withColumns({
        "total_customer_transactions": F.when(has, both("ids")),
        "avg_customer_transaction": F.when(has, F.try_divide(ssum.cast("double"), n.cast("double"))),
        "std_customer_transaction": F.when(has & (n > 1), F.sqrt(F.greatest(F.try_divide(m2, (n - 1).cast("double")), F.lit(0.0)))),
        "max_customer_transaction": F.when(has, F.greatest("_p_max", "_r_max")),
        "product_category_diversity": F.when(has, F.size(cats).cast("bigint")),
        "avg_daily_transaction_velocity": F.when(has, F.try_divide(both("dated").cast("double"), both("days").cast("double"))),
    })
    return y.drop(*[c for c in y.columns if c.startswith(("_r_", "_p_"))], "_new_day", "_dec", "_first_id")


def history_features(df: DataFrame, cust: DataFrame,
                     chunk_rows: int = DEFAULT_CHUNK_ROWS,
                     has_hot: bool | None = None, history: str = "all") -> DataFrame:
    """J1 + W1-W3 over ordered parts of each customer's rows.

    ``cust`` is ``customer_table(df)``. ``has_hot`` skips the split of large
    customers when it is known that no customer exceeds ``chunk_rows`` (None:
    check it). ``history='past'`` replaces the full-history customer aggregates
    by their value as of each row (leak-free); ``'all'`` is the reference's behaviour.
    Rows equal in customer, time and id have no defined order among them.
    """
    if history == "past":
        df = _first_ids(df)
    parts = ordered_parts(df, cust.select(CUST, "_n_rows"), CUST, [TS, TID], [TS, TID, AMT], chunk_rows, HALO_ROWS, has_hot, TID)
    w = Window.partitionBy(CUST, CHUNK).orderBy(*_order())
    if history == "past":
        j = _as_of(parts)
    else:
        j = parts.rows.join(parts.spread(cust.drop("_n_rows")), [CUST, CHUNK], "left")
    has_cust = F.col(CUST).isNotNull()
    prev_ts = F.lag(TS).over(w)
    gap_hours = F.expr(f"timestampdiff(MICROSECOND, _prev_ts, {TS})").cast("double") / F.lit(3.6e9)
    rolling = F.avg(AMT).over(w.rowsBetween(-HALO_ROWS, 0))
    return (j.withColumn("_prev_ts", prev_ts)
            .withColumn("time_since_last_transaction",
                        F.when(has_cust, F.coalesce(gap_hours, F.lit(0.0))).otherwise(F.lit(0.0)))
            .withColumn("_rolling", F.when(has_cust, rolling))
            .where(F.col(HALO) == 0)
            .withColumn("transaction_amount_ratio",
                        safe_div(F.col(AMT), F.col("avg_customer_transaction") + 1))
            .withColumn("amount_deviation_from_history",
                        safe_div(F.col(AMT) - F.col("_rolling"), F.col("_rolling") + 1))
            .drop("_prev_ts", "_rolling", HALO, CHUNK))


def interactions(df: DataFrame) -> DataFrame:
    """I1-I7."""
    c = F.col
    return df.withColumns({
        "amount_age_interaction": c(AMT) * c("customer_age"),
        "amount_velocity_interaction": c(AMT) * c("avg_daily_transaction_velocity"),
        "new_account_high_value": c("new_account") * c("high_amount_flag"),
        "weekend_high_value": c("is_weekend") * c("high_amount_flag"),
        "high_risk_profile": c("new_account") * c("high_amount_flag") * c("address_mismatch"),
        "velocity_deviation": c("avg_daily_transaction_velocity") * c("amount_deviation_from_history"),
        "suspicious_pattern": c("unusual_hour_flag") * c("high_amount_flag") * c("is_weekend"),
    })


# Output column order of the feature table (after the 16 source columns).
FEATURE_COLUMNS = [
    "address_mismatch", "day_of_week", "month", "is_weekend", "new_account",
    "amount_log", "amount_per_quantity", "amount_zscore", "hour_bin", "age_category",
    "account_age_weeks", "transaction_size", "quantity_log", "high_amount_flag",
    "high_quantity_flag", "unusual_hour_flag",
    "total_customer_transactions", "avg_customer_transaction", "std_customer_transaction",
    "max_customer_transaction", "product_category_diversity", "transaction_amount_ratio",
    "time_since_last_transaction", "amount_deviation_from_history",
    "avg_daily_transaction_velocity",
    "amount_age_interaction", "amount_velocity_interaction", "new_account_high_value",
    "weekend_high_value", "high_risk_profile", "velocity_deviation", "suspicious_pattern",
]


def feature_table(txn: DataFrame, stats: GlobalStats | None = None,
                  chunk_rows: int = DEFAULT_CHUNK_ROWS,
                  has_hot: bool | None = None, history: str = "all") -> DataFrame:
    """Entry 2: the whole feature derivation as one plan.

    ``stats`` defaults to statistics fitted on ``txn`` itself (the reference's
    behaviour); pass ``fit_global_stats(train_rows)`` for leak-free features.
    """
    if stats is None:
        stats = fit_global_stats(txn)
        # no customer can exceed chunk_rows when the whole input does not
        if has_hot is None and stats.n_rows is not None and stats.n_rows <= chunk_rows:
            has_hot = False
    source_cols = txn.columns
    base = stat_features(row_features(txn), stats)
    cust = customer_table(txn)
    hist = history_features(base, cust, chunk_rows=chunk_rows, has_hot=has_hot, history=history)
    out = interactions(hist)
    return out.select(*source_cols, *FEATURE_COLUMNS)


def past_customer_features(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                           has_hot: bool | None = None) -> DataFrame:
    """Leak-free variant of A2-A4/A7: each row sees only its customer's rows up
    to and including itself, in (time, id) order.

    Output: transaction_id plus past_total_customer_transactions,
    past_avg/std/max_customer_transaction, past_product_category_diversity,
    past_avg_daily_transaction_velocity. The same scan as ``history='past'``.
    """
    base = df.where(F.col(CUST).isNotNull()).select(CUST, TID, TS, AMT, "product_category")
    sizes = base.groupBy(CUST).agg(F.count(F.lit(1)).alias("_n_rows"))
    rows = _as_of(ordered_parts(_first_ids(base), sizes, CUST, [TS, TID], [TS, TID, AMT], chunk_rows, HALO_ROWS, has_hot, TID))
    names = {c: f"past_{c}" if "customer" in c or c.startswith(("product", "avg_daily")) else c for c in CUSTOMER_COLUMNS}
    return rows.where(F.col(HALO) == 0).select(TID, *[F.col(c).alias(n) for c, n in names.items()])
