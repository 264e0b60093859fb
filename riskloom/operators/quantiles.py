"""Exact quantiles and modes without gathering a column's values in one task.

The two order statistics around each quantile are bracketed by sketch quantiles.
One pass counts the values below, at and between a bracket's ends; a rank that
falls on the copies of an end is that end, and any other goes on in an open
bracket that holds neither end. Brackets shrink, all columns in one pass, until
at most SMALL values are left inside, and only those are sorted. The result is
exact at every size and for any number of equal values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values inside a bracket that one task sorts.
SMALL = 50_000
#: Rank error of the bracketing sketch, as 1 / ACCURACY of the values inside.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs) -> dict[str, list]:
    """name -> values at probs (linear interpolation between neighbours); None for a column without values. Nulls and NaN are no values."""
    names = list(columns)
    x = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    x = x.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in x.columns])
    counts = x.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(len(names))]).first() if names else []
    # wanted ranks of each column, and what is known of each: values up to the bracket, its open ends, values inside
    open_ = {}
    for i in range(len(names)):
        for p in probs if counts[i] else []:
            at = p * (counts[i] - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                open_[i, rank] = (0, None, None, counts[i])
    done: dict[tuple[int, int], float] = {}
    while True:
        wide = {k: v for k, v in open_.items() if v[3] > SMALL}
        if not wide:
            break
        # ranks of one column in one bracket share a sketch
        shared: dict[tuple, list] = {}
        for (i, rank), (before, lo, hi, n) in wide.items():
            shared.setdefault((i, lo, hi), []).append(((i, rank), _around(rank - before, n)))
        got = x.agg(*[F.percentile_approx(_inside(*k), [p for _, ends in v for p in ends], ACCURACY).alias(f"q{j}") for j, (k, v) in enumerate(shared.items())]).first()
        ends = {k: got[j][2 * m:2 * m + 2] for j, v in enumerate(shared.values()) for m, (k, _) in enumerate(v)}
        true = x.agg(*[a for j, (i, rank) in enumerate(wide) for a in _counts(F.col(f"c{i}"), *ends[i, rank], j)]).first()
        for j, (i, rank) in enumerate(wide):
            _, lo, hi, _ = wide[i, rank]
            a, b = ends[i, rank]
            low, at_a, mid, at_b = (true[f"{name}{j}"] for name in ("low", "a", "mid", "b"))
            if rank < low:
                open_[i, rank] = (wide[i, rank][0], lo, a, low - wide[i, rank][0])
            elif rank < low + at_a:
                done[i, rank] = a
            elif rank < low + at_a + mid:
                open_[i, rank] = (low + at_a, a, b, mid)
            elif rank < low + at_a + mid + at_b:
                done[i, rank] = b
            else:
                before = low + at_a + mid + at_b
                open_[i, rank] = (before, b, hi, wide[i, rank][0] + wide[i, rank][3] - before)
            if (i, rank) in done:
                del open_[i, rank]
    if open_:
        row = x.agg(*[F.element_at(F.sort_array(F.collect_list(_inside(i, lo, hi))), rank - before + 1).alias(f"v{j}")
                      for j, ((i, rank), (before, lo, hi, _)) in enumerate(open_.items())]).first()
        done |= dict(zip(open_, row))
    out = {}
    for i, name in enumerate(names):
        out[name] = []
        for p in probs:
            if not counts[i]:
                out[name].append(None)
                continue
            at = p * (counts[i] - 1)
            low, high = done[i, math.floor(at)], done[i, math.ceil(at)]
            out[name].append(low + (high - low) * (at - math.floor(at)))
    return out


def _counts(c: Column, a: float, b: float, j: int) -> list[Column]:
    """Values below a, at a, between, and at b (none if that is a)."""
    at_b = F.count_if(c == b) if a != b else F.lit(0)
    return [F.count_if(c < a).alias(f"low{j}"), F.count_if(c == a).alias(f"a{j}"), F.count_if((c > a) & (c < b)).alias(f"mid{j}"), at_b.alias(f"b{j}")]


def _inside(i: int, lo, hi) -> Column:
    """The column's values strictly between lo and hi (None: no end)."""
    c = F.col(f"c{i}")
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (c > lo)
    if hi is not None:
        keep = keep & (c < hi)
    return F.when(keep, c)


def _around(rank: int, n: int) -> list[float]:
    p, slack = rank / max(1, n - 1), 2 / ACCURACY
    return [max(0.0, p - slack), min(1.0, p + slack)]


def exact_modes(df: DataFrame, columns) -> dict[str, str | None]:
    """Most frequent value of each column as text (the smallest of equals); counted by a partially aggregated groupBy."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("c", "v").agg((-F.count(F.lit(1))).alias("n"))
    top = {r["c"]: r["v"] for r in counts.groupBy("c").agg(F.min(F.struct("n", "v")).alias("t")).select("c", "t.v").collect()}
    return {c: top.get(c) for c in columns}
