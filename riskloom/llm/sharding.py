"""Best-fit-decreasing bin packing of indivisible groups into shards.

Groups (here: rows with equal texts) are sorted by size; each enters the bin
with the least remaining room that still holds it, found in a balanced tree.

At scale no task and not the driver sees all groups. Packing runs on two levels,
both best-fit-decreasing. Each task packs its share of the groups into bundles
of three capacities: fractions of a shard, most bytes in the largest, the last
few bytes in fine ones. Then the bundles, a number set by the shard count and
the task count, are packed into the shards; the fine bundles fill the gaps.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import lookup, text_digest, written

#: Bytes added to every row's text.
ROW_BYTES = 16
#: A shard is this many times the coarse bundle; finer bundles are 1/16 of the one before.
BUNDLES_PER_SHARD = 64
#: Bins of a part that go on to the next level, where shards have a fixed capacity.
OPEN_BINS = 64
GROUPS_PER_TASK = 200_000
ROWS_PER_SLOT_RUN = 20_000


class RoomTree:
    """A balanced (AA) tree of (room, bin) pairs."""

    def __init__(self):
        self.root = None  # node: [key, level, left, right]

    def add(self, key):
        self.root = self._add(self.root, key)

    def remove(self, key):
        self.root = self._remove(self.root, key)

    def tightest(self, need):
        """The least pair whose room is at least need, or None."""
        node, best = self.root, None
        while node:
            if node[0][0] >= need:
                node, best = node[2], node[0]
            else:
                node = node[3]
        return best

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[1] == t[3][3][1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def _add(self, t, key):
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._add(t[side], key)
        return self._split(self._skew(t))

    def _remove(self, t, key):
        if t is None:
            return None
        if key < t[0]:
            t[2] = self._remove(t[2], key)
        elif key > t[0]:
            t[3] = self._remove(t[3], key)
        elif t[2] is None:
            return t[3]
        else:
            heir = t[2]
            while heir[3]:
                heir = heir[3]
            t[0] = heir[0]
            t[2] = self._remove(t[2], heir[0])
        low = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if low < t[1]:
            t[1] = low
            if t[3] and low < t[3][1]:
                t[3][1] = low
        t = self._skew(t)
        if t[3]:
            t[3] = self._skew(t[3])
            if t[3][3]:
                t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        if t[3]:
            t[3] = self._split(t[3])
        return t


def best_fit(sizes, capacity: int) -> list[int]:
    """Bin of each size; sizes must fall. A size over the capacity has a bin to itself."""
    tree, out, n = RoomTree(), [], 0
    for size in sizes:
        if size > capacity:
            out.append(n)
            n += 1
            continue
        room = tree.tightest(size)
        if room is None:
            room, n = (capacity, n), n + 1
        else:
            tree.remove(room)
        out.append(room[1])
        if room[0] > size:
            tree.add((room[0] - size, room[1]))
    return out


def fit_into(sizes, n_bins: int) -> list[int]:
    """Best fit with the least capacity found that needs no more than n_bins bins.

    Sizes over an even share take a bin each; the others share the other bins evenly.
    """
    whole, bins = list(sizes), n_bins
    big = 0
    while big < len(whole) and bins > 1 and whole[big] * bins > sum(whole[big:]):
        big, bins = big + 1, bins - 1
    rest = whole[big:]
    if not rest:
        return list(range(big))
    even = max(-(-sum(rest) // bins), rest[0])
    low, step, found = even - 1, max(1, even >> 14), None
    while found is None:
        got = best_fit(rest, low + step)
        if max(got) < bins:
            found, high = got, low + step
        else:
            low, step = low + step, 2 * step
    for _ in range(6):
        if high - low <= max(1, even >> 16):
            break
        got = best_fit(rest, mid := (low + high) // 2)
        if max(got) < bins:
            found, high = got, mid
        else:
            low = mid
    return [*range(big), *(big + b for b in found)]


def _bundles(capacity: int):
    """Packs one task's groups into bundles of capacity, capacity/16 and capacity/256."""

    def pack(batches):
        part = pd.concat(list(batches) or [pd.DataFrame({"key": [], "bytes": [], "part": []})])
        if not len(part):
            return
        part = part.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        sizes = part["bytes"].to_numpy(np.int64)
        before = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        level = (before >= total * 15 / 16).astype(int) + (before >= total * 255 / 256)
        bundle = np.zeros(len(part), np.int64)
        made = 0
        for k in range(3):
            at = np.flatnonzero(level == k)
            if len(at):
                got = np.array(best_fit(sizes[at].tolist(), max(1, capacity >> 4 * k)))
                bundle[at] = made + got
                made += int(got.max()) + 1
        yield pd.DataFrame({"key": part["key"].to_numpy(), "bytes": sizes, "bundle": (part["part"].to_numpy(np.int64) << 32) + bundle})

    return pack


def pack_groups(groups: DataFrame, n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(key, bytes) rows with distinct keys to (key, bytes, shard).

    Give n_shards (their sizes come out near equal), or a fixed capacity: tasks
    pack parts of the groups best-fit-decreasing, and the OPEN_BINS emptiest
    bins of each part go on, as wholes, to a next level of fewer tasks, until one
    task holds the rest; nothing reaches the driver. A group larger than a
    shard's share is not divided: it is a shard's only group.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    if capacity:
        return _pack_to_capacity(groups.select("key", "bytes"), capacity)
    spark = groups.sparkSession
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    share = max(1, -(-total // n_shards))
    tasks = max(1, math.ceil(count / GROUPS_PER_TASK))
    parts = groups.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("part"))
    units = written(parts.groupBy("part").applyInPandas(lambda p: next(_bundles(max(1, share // BUNDLES_PER_SHARD))([p])), "key binary, bytes long, bundle long"), "shard-units")
    # at most 3 * 2 * shards * 64 bundles that are half full, and 3 * tasks others
    bundles = sorted(((int(r[1]), r[0]) for r in units.groupBy("bundle").agg(F.sum("bytes")).collect()), key=lambda x: (-x[0], x[1]))
    sizes = [b for b, _ in bundles]
    shard = fit_into(sizes, n_shards)
    placed = spark.createDataFrame(pd.DataFrame({"bundle": np.array([b for _, b in bundles], np.int64), "shard": np.array(shard, np.int32)}), "bundle long, shard int")
    return units.join(placed, "bundle").select("key", "bytes", "shard")


def _pack_to_capacity(groups: DataFrame, capacity: int) -> DataFrame:
    """(key, bytes, shard): whole shards are packed in tasks, level by level."""
    units = groups.select(F.col("key").alias("unit"), F.col("bytes").cast("long").alias("bytes"))
    levels = []
    while True:
        level, tasks = len(levels), max(1, math.ceil(units.count() / GROUPS_PER_TASK))

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["bytes", "unit"], ascending=[False, True], kind="stable")
            sizes = part["bytes"].to_numpy(np.int64)
            got = np.array(best_fit(sizes.tolist(), capacity))
            filled = np.bincount(got, weights=sizes)
            emptiest = np.argsort(filled, kind="stable")[:OPEN_BINS if tasks > 1 else 0]
            open_ = np.isin(got, emptiest[filled[emptiest] < capacity])
            closed = np.cumsum(~np.isin(np.arange(len(filled)), got[open_])) - 1  # closed bins are numbered without gaps
            name = [f"{level}.{part['part'].iloc[0]}.{b}".encode() for b in got]
            return pd.DataFrame({"unit": part["unit"].to_numpy(), "bytes": sizes, "part": part["part"].to_numpy(), "bin": name, "at": np.where(open_, -1, closed[got])})

        parts = units.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(tasks)))
        placed = written(parts.groupBy("part").applyInPandas(pack, "unit binary, bytes long, part long, bin binary, at long"), "shard-bins")
        levels.append(placed)
        if tasks == 1:
            break
        units = written(placed.where("at < 0").groupBy(F.col("bin").alias("unit")).agg(F.sum("bytes").alias("bytes")), "shard-open-bins")
    # a shard's number: the closed bins of the levels and parts before, a row for each part
    made = None
    for level, placed in enumerate(levels):
        own = placed.where("at >= 0").groupBy("part").agg((F.max("at") + 1).alias("n")).select(F.lit(level).alias("level"), "part", "n")
        made = own if made is None else made.unionByName(own)
    before = Window.orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = made.select("level", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    out = None
    for level in range(len(levels) - 1, -1, -1):
        own = levels[level].join(F.broadcast(first.where(F.col("level") == level).drop("level")), "part", "left")
        own = own.select("unit", "bytes", "bin", F.when(F.col("at") >= 0, F.col("first") + F.col("at")).alias("shard"))
        if out is not None:  # an open bin has the shard that a later level gave it
            later = out.select(F.col("unit").alias("bin"), F.col("shard").alias("later"))
            own = own.join(later, "bin", "left").withColumn("shard", F.coalesce("shard", "later"))
        out = own.select("unit", "bytes", "shard")
    return out.select(F.col("unit").alias("key"), "bytes", F.col("shard").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, shard, slot, group_rows.

    Size is the text's UTF-8 bytes (null: none) plus 16. Rows with equal texts
    are one indivisible group; null texts are one, empty texts another. A group
    over an even share has a shard to itself and the other shards are even.
    Slots number a shard's rows from 0 without gaps, in runs of rows; repeated
    rows each have a slot. A null id is kept. text_crc32 of a null text is 0.
    An empty table gives no rows. Other columns are not read.
    """
    text, nothing = F.col("text"), F.lit(b"").cast("binary")
    base = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(text_digest(text, 256), nothing).alias("key")), "shard-rows")
    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("group_rows"))
    packed = written(pack_groups(groups, n_shards).join(groups.select("key", "group_rows"), "key"), "shard-groups")
    runs = max(1, math.ceil(base.count() / (n_shards * ROWS_PER_SLOT_RUN)))
    rows = lookup(base, packed.select("key", "shard", "group_rows"), "key", packed.select("key", F.col("group_rows").alias("n"))) \
        .withColumn("run", F.pmod(F.xxhash64("doc_id", "key"), F.lit(runs)))
    in_shard = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "run").agg(F.count("*").alias("n")) \
        .select("shard", "run", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("start"))
    in_run = Window.partitionBy("shard", "run").orderBy("doc_id", "key")
    return rows.withColumn("place", F.row_number().over(in_run)).join(starts, ["shard", "run"]) \
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "group_rows")
