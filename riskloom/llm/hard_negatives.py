"""Hard negatives of anchors, with score bounds along a spanning tree of the anchors.

Rows are dealt to cells; every cell meets all anchors, one block of near anchors
after the other. In a block the first anchor scores the whole cell. Along each
edge of the block's least spanning tree, a child's score lies within the edge's
length times the candidate's norm of its parent's, so a child rescores only
candidates whose bounds overlap a window that still needs them. Candidates not
rescored pass their widened bounds on. A cell's best rows of each window meet
in a second shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import NULL_ID, written

#: Rows in a cell at most (on average), and cells at least where there are rows for them.
CELL_ROWS, CELLS, LEAST_ROWS = 1 << 16, 64, 1 << 10
#: Anchors that share a spanning tree, and anchors that stand for regions when near ones are put together.
BLOCK_ANCHORS, PIVOTS = 512, 64
#: Relative rounding that bounds allow for.
SLACK = 1e-9
#: Candidates, in partners wanted, that each window scores before it is narrowed.
PROBES = 4

FOUND = "key long, anchor_id long, window long, score long, id long"


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vector_col holds integers; a score is an inner product, as a 64-bit integer
    (of vectors of unequal length, over the places that both have). anchor says
    which rows are anchors. An anchor's positives are the best rows of its label;
    a positive's negatives are the best rows of other labels that score low to
    high percent of the positive's score. Ties go to the smaller id, null ids
    first. Rows with a null label, vector or component take no part. Rows of the
    anchor's own id are never among its partners; other repeated rows count
    each for itself, but a repeated anchor row gives its result once. Anchors without
    positives or negatives give no rows; an empty table gives none.
    Only counts and PIVOTS anchors reach the driver.
    """
    whole = F.coalesce(F.forall(vector_col, lambda x: x.isNotNull()), F.lit(False))
    rows = rows.where(F.col(label_col).isNotNull() & whole).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    cells = max(1, _cells(rows.count()))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(cells)))
    anchors = _blocks(rows.where("anchor").select("id", "label", "vector").distinct())
    every = F.array(F.lit(None).cast("long"))
    first = _best(_meet(rows, anchors.withColumn("windows", every), cells, positives, low, high), positives)
    first = written(first.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = first.groupBy("key").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    second = _best(_meet(rows, anchors.join(wanted, "key"), cells, negatives, low, high), negatives)
    out = first.join(second.withColumnRenamed("window", "positive_score"), ["key", "positive_score"])
    null = F.lit(NULL_ID)
    return out.select(F.nullif("anchor_id", null).alias("anchor_id"), F.nullif("positive_id", null).alias("positive_id"), "rank",
                      F.nullif("id", null).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _cells(n: int) -> int:
    return max(math.ceil(n / CELL_ROWS), min(CELLS, math.ceil(n / LEAST_ROWS)))


def _blocks(anchors: DataFrame) -> DataFrame:
    """key, block and the anchors' columns: near anchors share a block."""
    n = anchors.count()
    pivots = anchors.orderBy(F.xxhash64("id", "label", "vector")).limit(PIVOTS).select("vector").toArrow().column("vector")
    centres = matrix(pivots.combine_chunks()) if n else np.zeros((0, 0))

    def nearest(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), centres.shape[1])
            c = np.pad(centres, ((0, 0), (0, x.shape[1] - centres.shape[1])))
            near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "pivot"])

    near = anchors.mapInArrow(nearest, "id long, label long, vector array<long>, pivot long")
    dealt = near.repartitionByRange(max(1, math.ceil(n / BLOCK_ANCHORS)), "pivot", "id")
    return written(dealt.select(F.monotonically_increasing_id().alias("key"), F.spark_partition_id().alias("block"), "id", "label", "vector"), "anchors")


def _meet(rows: DataFrame, anchors: DataFrame, cells: int, k: int, low: int, high: int) -> DataFrame:
    """The k best rows of each cell in each window of each anchor.

    Window null: all other rows of the anchor's label. Window s: rows of other
    labels whose scores are low to high percent of s.
    """
    nothing = F.lit(None)
    left = rows.select("cell", F.lit(-1).alias("block"), F.lit(-1).cast("long").alias("key"), "id", "label", "vector", nothing.cast("array<long>").alias("windows"))
    right = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), "block", "key", "id", "label", "vector", "windows")
    both = left.unionByName(right).repartition(cells, "cell").sortWithinPartitions("cell", "block", "key")

    def run(batches):
        cell, here = None, None
        for (at, block), part in _runs(batches):
            if block < 0:
                cell, here = at, Cell(part)
            elif at == cell:
                for i in range(0, part.num_rows, BLOCK_ANCHORS):
                    found = here.search(part.slice(i, BLOCK_ANCHORS), k, low, high)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), from_pandas=False) if not isinstance(c, pa.Array) else c for c in found], ["key", "anchor_id", "window", "score", "id"])

    return both.mapInArrow(run, FOUND)


def _runs(batches) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """Consecutive rows of one cell and block, whatever batches they come in."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if (now := (int(cell[a]), int(block[a]))) != at:
                if held:
                    yield at, pa.Table.from_batches(held)
                held, at = [], now
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def matrix(vectors: pa.Array, least: int = 0) -> np.ndarray:
    """Rows of one length (that of the longest, and least at least), filled with zeros; float64 where that is exact."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    d = max([least, *size[:1], int(size.max(initial=0))])
    if (size == d).all():
        out = flat.reshape(len(size), d)
    else:
        out = np.zeros((len(size), d), np.int64)
        out[np.arange(d) < size[:, None]] = flat
    return out.astype(np.float64) if not len(flat) or max(int(flat.max()), -int(flat.min())) < 1 << 52 else out


class Cell:
    """The candidates of one cell."""

    def __init__(self, rows: pa.Table):
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        self.x = matrix(rows.column("vector"))
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        self.rescored = 0

    def scores(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Inner products; in floating point only where every sum is exact."""
        most = [float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (x, a)]
        if len(a) * most[0] * most[1] < 2.0 ** 53:
            return np.rint(x.astype(np.float64, copy=False) @ a.astype(np.float64)).astype(np.int64)
        return x.astype(np.int64) @ a.astype(np.int64)

    def search(self, anchors: pa.Table, k: int, low: int, high: int) -> list:
        """key, anchor_id, window, score, id: the k best candidates of each anchor and window."""
        a = matrix(anchors.column("vector"), self.x.shape[1])
        if a.shape[1] > self.x.shape[1]:
            self.x = np.pad(self.x, ((0, 0), (0, a.shape[1] - self.x.shape[1])))
        key, ids, labels = (anchors.column(c).to_numpy() for c in ("key", "id", "label"))
        windows = anchors.column("windows").to_pylist()
        found: list[list] = [[] for _ in range(5)]
        for node, parent, length, bounds in walk(a):
            if parent is None:
                lo = hi = exact = self.scores(self.x, a[node])
                lo, hi = _outer(exact, -1), _outer(exact, 1)
                self.rescored += len(exact)
            else:
                far = length * (1 + SLACK) * self.norm
                lo, hi = bounds[0] - far, bounds[1] + far
                exact = None
            same = self.labels == labels[node]
            other = self.ids != ids[node]
            masks = []
            for w in windows[node]:
                ok = other & (same if w is None else ~same)
                least, most = (-math.inf, math.inf) if w is None else (-(-low * w // 100), high * w // 100)
                masks.append((w, least, most, ok & (hi >= least) & (lo <= most)))
            if exact is None:
                # the most promising of each window first: their scores raise the windows' lower ends
                probe = np.unique(np.concatenate([_greatest(np.flatnonzero(m), hi, PROBES * k) for *_, m in masks]))
                score = self.scores(self.x[probe], a[node])
                lo[probe], hi[probe] = _outer(score, -1), _outer(score, 1)
                for _, least, most, mask in masks:
                    inside = lo[mask & (lo >= least) & (hi <= most)]
                    mask &= hi >= (np.partition(inside, -k)[-k] if len(inside) >= k else least)
                    mask &= lo <= most
                at = np.flatnonzero(np.logical_or.reduce([m for *_, m in masks]))
                self.rescored += len(probe) + len(at)
                if len(at) * 4 > len(lo):  # gathering costs more than scoring all
                    exact = self.scores(self.x, a[node])
                    lo, hi, score = _outer(exact, -1), _outer(exact, 1), exact[at]
                else:
                    score = self.scores(self.x[at], a[node])
                    lo[at], hi[at] = _outer(score, -1), _outer(score, 1)
            else:
                at = np.arange(len(exact))
                score = exact
            for w, least, most, mask in masks:
                own = np.flatnonzero(mask[at] & (score >= least) & (score <= most))
                if len(own) > k:
                    own = own[score[own] >= np.partition(score[own], -k)[-k]]
                own = own[np.lexsort((self.ids[at[own]], -score[own]))][:k]
                found[0].append(np.full(len(own), key[node]))
                found[1].append(np.full(len(own), ids[node]))
                found[2].append(pa.array([w] * len(own), pa.int64()))
                found[3].append(score[own])
                found[4].append(self.ids[at[own]])
            bounds[:] = lo, hi
        return [pa.concat_arrays(c) if i == 2 else np.concatenate(c) if c else np.zeros(0, np.int64) for i, c in enumerate(found)]


def _greatest(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return at if len(at) <= n else at[np.argpartition(value[at], -n)[-n:]]


def _outer(score: np.ndarray, side: int) -> np.ndarray:
    """The scores as floats, not above (side -1) or not below (side 1) their exact values."""
    out = score.astype(np.float64)
    return np.where(np.abs(out) < 2.0 ** 53, out, np.nextafter(out, side * math.inf))


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each row in a least spanning tree by distance (the first row: -1), and the length of that edge."""
    a = a.astype(np.float64)
    n = len(a)
    square = (a * a).sum(1)
    parent, near = np.full(n, -1), np.full(n, math.inf)
    left, now = np.ones(n, bool), 0
    for _ in range(n - 1):
        left[now] = False
        gap = square + square[now] - 2 * (a @ a[now])
        closer = left & (gap < near)
        near[closer], parent[closer] = gap[closer], now
        now = int(np.argmin(np.where(left, near, math.inf)))
    edge = a - a[np.maximum(parent, 0)]
    return parent, np.sqrt((edge * edge).sum(1))


def walk(a: np.ndarray) -> Iterator[tuple[int, int | None, float, list]]:
    """node, parent, length of their edge, and a list that holds the parent's bounds and takes the node's.

    Depth first, children of few descendants first: bounds are kept of as many
    nodes at once as the logarithm of their number.
    """
    parent, length = spanning_tree(a)
    children: list[list[int]] = [[] for _ in parent]
    order, size = [0], np.ones(len(parent), np.int64)
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    for i in order:
        order += children[i]
    for i in reversed(order[1:]):
        size[parent[i]] += size[i]
    stack: list[tuple[int, int | None, list]] = [(0, None, [None, None])]
    while stack:
        node, above, bounds = stack.pop()
        yield node, above, float(length[node]), (own := list(bounds))
        del bounds
        # the largest subtree comes last, when nothing else holds these bounds
        stack += [(c, node, own) for c in sorted(children[node], key=lambda c: -size[c])]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their rank."""
    order = Window.partitionBy("key", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
