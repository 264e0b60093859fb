"""Row-level feature expressions (F2-F17, I1-I7) as plain Catalyst columns.

Null semantics follow pandas as used by the reference: a comparison with a
missing value is False, so flags are ``coalesce(cond, 0)``; an inequality with a
missing value is True, so the address mismatch is ``coalesce(ship != bill, 1)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "flag", "address_mismatch", "hour_bin", "age_category", "account_age_weeks",
    "transaction_size", "safe_div", "HOUR_BINS", "AGE_BINS", "SIZE_BINS",
    "round_doubles",
]

# Bin labels in bin order (first label is the one dropped by one-hot).
HOUR_BINS = ["Night", "Morning", "Afternoon", "Evening"]
AGE_BINS = ["Young", "Young_Adult", "Adult", "Senior", "Elder"]
SIZE_BINS = ["Very_Small", "Small", "Medium", "Large", "Very_Large"]


def flag(cond: Column) -> Column:
    """0/1 int flag; a null condition counts as False."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null instead of failing on a zero divisor (ANSI)."""
    return F.try_divide(num, den)


def address_mismatch(ship: str = "shipping_address", bill: str = "billing_address") -> Column:
    return F.coalesce((F.col(ship) != F.col(bill)).cast("int"), F.lit(1))


def hour_bin(hour: Column) -> Column:
    """Right-closed bins (-inf,6], (6,12], (12,18], (18,inf)."""
    return (F.when(hour <= 6, HOUR_BINS[0]).when(hour <= 12, HOUR_BINS[1])
            .when(hour <= 18, HOUR_BINS[2]).when(hour.isNotNull(), HOUR_BINS[3]))


def age_category(age: Column) -> Column:
    """Right-closed bins (0,25], (25,35], (35,50], (50,65], (65,inf); <=0 -> null."""
    return (F.when(age <= 0, F.lit(None).cast("string"))
            .when(age <= 25, AGE_BINS[0]).when(age <= 35, AGE_BINS[1])
            .when(age <= 50, AGE_BINS[2]).when(age <= 65, AGE_BINS[3])
            .when(age.isNotNull(), AGE_BINS[4]))


def account_age_weeks(days: Column) -> Column:
    """Floor division by 7 (floor, not truncation, for negative ages)."""
    return F.floor(days / F.lit(7.0)).cast("bigint")


def transaction_size(amount: Column, q20: float, q40: float, q60: float, q80: float) -> Column:
    """Quintile label, right-closed with the lowest edge included.

    Duplicate edges simply leave a bin empty.
    """
    return (F.when(amount <= q20, SIZE_BINS[0]).when(amount <= q40, SIZE_BINS[1])
            .when(amount <= q60, SIZE_BINS[2]).when(amount <= q80, SIZE_BINS[3])
            .when(amount.isNotNull(), SIZE_BINS[4]))


def round_doubles(df, places: int = 6):
    """Round every double column (used for cross-engine comparison only)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            cols.append(F.round(F.col(f"`{f.name}`"), places).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
