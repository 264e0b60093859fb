"""K1: exact k nearest neighbours (Euclidean) between two row sets.

Candidates are dealt to cells, each around a pivot (one of a bounded,
hash-chosen sample of candidates). The k-th distance to the sample bounds a
query's k-th distance to all candidates, and by the triangle inequality no
candidate of a cell is nearer than (distance to the pivot - the cell's radius),
so a query visits only the cells where that is within its bound. The result is
exact: cells that are left out cannot hold a neighbour.

Each visited block is one cogroup task. Distances in single precision, with
their rounding allowed for, pick the few candidates whose distances are then
taken exactly; a bounded merge keeps the global k. Large cells are split into
blocks of about ``block_rows`` candidates, and the queries of a cell into blocks
of as many queries, so no task grows with a cell; arrays and yielded batches are
of bounded rows. By default blocks grow with the two sides, up to MAX_BLOCK_ROWS:
a row is sent once for each block of the other side, so that up to there the
number of copies is bounded and what is shuffled grows with the rows, not with
their square. Vectors of neighbours are joined on at the end. Ties are broken by candidate id (as text), so the result does
not depend on partitioning. Rows with a null vector have no neighbours and are none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BLOCK_ROWS, MAX_BLOCK_ROWS = 8192, 131_072
# Pairs of blocks, of queries and candidates, that the default block size aims at.
BLOCK_PAIRS = 256
# Candidates of the sample, and so pivots and cells, at most: they are sent to all tasks.
SAMPLE_ROWS = 4096
# Query rows whose distances to the sample are held at once, and rows of a yielded batch of visits.
QUERY_ROWS, VISIT_ROWS = 512, 4096
# Distances to a block that are held at once.
CELLS = 1 << 20


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.maximum(d2, 0, out=d2)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _same(qcode: np.ndarray, ccode: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (query, candidate) places of equal codes."""
    order = np.argsort(ccode, kind="stable")
    first, last = (np.searchsorted(ccode[order], qcode, side) for side in ("left", "right"))
    n = last - first
    row = np.repeat(np.arange(len(qcode)), n)
    return row, order[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]


def nearest_in_block(Q: np.ndarray, C: np.ndarray, qcode: np.ndarray, ccode: np.ndarray, k: int, exclude_self: bool, bound: np.ndarray | None = None):
    """(query, candidate, distance) of the k nearest candidates of each query, by distance and code.

    ``bound``: squares of distances within which a query's k nearest of all blocks lie; farther candidates may be left out.
    """
    kk, d, parts = min(k, len(C)), C.shape[1], []
    # around the candidates' mean, single precision loses least
    middle = C.mean(axis=0)
    near = C - middle
    square = (near * near).sum(axis=1)
    far = float(square.max(initial=0.0))
    # one product gives the squared distances: (-2q, q.q, 1) by (c, 1, c.c)
    C32 = np.concatenate([near, np.ones((len(C), 1)), square[:, None]], axis=1).astype(np.float32).T.copy()
    same = _same(qcode, ccode) if exclude_self else None
    step = max(1, min(QUERY_ROWS, CELLS // max(1, len(C))))
    for a in range(0, len(Q), step):
        q = Q[a:a + step] - middle
        own = (q * q).sum(axis=1)
        d2 = np.concatenate([-2 * q, np.ones((len(q), 1)) * own[:, None], np.ones((len(q), 1))], axis=1).astype(np.float32) @ C32
        if exclude_self:
            i, j = np.searchsorted(same[0], [a, a + len(q)])
            d2[same[0][i:j] - a, same[1][i:j]] = np.inf
        # rounding of the inputs, of the products' sums and of the norms, on both sides of the comparison
        slack = (4 * d + 16) * np.finfo(np.float32).eps * (own + far + 1e-30)
        limit = np.full(len(q), np.inf) if bound is None else bound[a:a + step] + slack
        wide = np.flatnonzero(~np.isfinite(limit))
        if len(wide):
            kth = np.partition(d2[wide], kk - 1, axis=1)[:, kk - 1]
            limit[wide] = np.where(np.isfinite(kth), kth, np.finfo(np.float32).max) + slack[wide]
        row, col = np.divmod(np.flatnonzero(d2 <= np.minimum(limit, np.finfo(np.float32).max).astype(np.float32)[:, None]), len(C))
        rough = d2[row, col]
        order = np.lexsort((rough, row))
        row, col, rough = row[order], col[order], rough[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = np.full(len(q), np.inf)
        kth[row[place == kk - 1]] = rough[place == kk - 1]
        keep = rough <= kth[row] + slack[row]
        row, col = row[keep], col[keep]
        exact = ((C[col] - Q[a + row]) ** 2).sum(axis=1)
        order = np.lexsort((ccode[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < kk
        parts.append((a + row[keep], col[keep], np.sqrt(exact[keep])))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_topk(k: int, exclude_self: bool):
    """The k nearest of a block's candidates to each of its queries."""
    schema = pa.schema([("qid", pa.string()), ("cid", pa.string()), ("dist", pa.float64()), ("clabel", pa.float64()), ("chash", pa.int64())])

    def fn(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        # ids as numbers in the order of their texts
        ids = np.concatenate([q.column("qid").to_numpy().astype(str), c.column("cid").to_numpy().astype(str)])
        _, code = np.unique(ids, return_inverse=True)
        row, col, dist = nearest_in_block(_matrix(q.column("vec")), _matrix(c.column("vec")), code[:q.num_rows], code[q.num_rows:], k, exclude_self, q.column("bound").to_numpy())
        out = [q.column("qid").take(row), c.column("cid").take(col), pa.array(dist), c.column("clabel").take(col), c.column("chash").take(col)]
        return pa.Table.from_arrays(out, schema=schema)

    return fn


class _Cells:
    """The sample (its first rows are the pivots) and the cells' radii and sizes: small, sent to all tasks."""

    def __init__(self, sample: np.ndarray, ids: list, radius: np.ndarray, size: np.ndarray, block_rows: int):
        self.sample, self.place, self.radius, self.size = sample, {}, radius, size
        for n, i in enumerate(ids):  # ids may repeat
            self.place.setdefault(i, []).append(n)
        self.blocks = np.maximum(1, -(-size // block_rows))

    def bounds(self, square: np.ndarray, ids: list, k: int, exclude_self: bool) -> np.ndarray:
        """An upper bound of each query's k-th distance, from its squared distances to the sample."""
        if exclude_self:
            own = [(r, n) for r, i in enumerate(ids) for n in self.place.get(i, ())]
            if own:
                square = square.copy()
                square[tuple(zip(*own))] = np.inf
        if square.shape[1] < k:
            return np.full(len(square), np.inf)
        return np.sqrt(np.partition(square, k - 1, axis=1)[:, k - 1])


def _nearest(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"))
                cell = np.concatenate([_squares(x[i:i + QUERY_ROWS], pivots).argmin(axis=1) for i in range(0, len(x), QUERY_ROWS)])
                exact = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(exact)], [*batch.schema.names, "cell", "pdist"])
    return run


def _open_cells(batch: pa.RecordBatch, cells: _Cells, k: int, exclude_self: bool):
    """(query, cell) places of the cells within each query's bound, and the bounds' squares."""
    x = _matrix(batch.column("vec"))
    square = _squares(x, cells.sample)
    bound = cells.bounds(square, batch.column("qid").to_pylist(), k, exclude_self)
    # rounding of the products' sums and of the norms
    bound = bound * bound + (4 * x.shape[1] + 16) * np.finfo(float).eps * ((x * x).sum(axis=1) + (cells.sample ** 2).sum(axis=1).max())
    dist = np.sqrt(square[:, :len(cells.radius)])
    slack = 1e-6 * (1.0 + dist)
    row, cell = np.nonzero((cells.size > 0)[None, :] & (dist - cells.radius[None, :] - slack <= np.sqrt(bound)[:, None]))
    return row, cell, bound


def _visits(cells: _Cells, k: int, exclude_self: bool):
    """The blocks of all cells within each query's bound, in batches of VISIT_ROWS rows at most."""
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(start, QUERY_ROWS)
                row, cell, bound = _open_cells(batch, cells, k, exclude_self)
                n = cells.blocks[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                for i in range(0, len(row), VISIT_ROWS):
                    at = row[i:i + VISIT_ROWS]
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bound[at]), pa.array(cell[i:i + VISIT_ROWS].astype(np.int32)), pa.array(block[i:i + VISIT_ROWS].astype(np.int32))],
                                                     [*batch.schema.names, "bound", "cell", "block"])
    return run


def _visitors(cells: _Cells, k: int, exclude_self: bool):
    """How many queries of a partition visit each cell."""
    def run(batches):
        total = np.zeros(len(cells.radius), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_ROWS):
                total += np.bincount(_open_cells(whole.slice(start, QUERY_ROWS), cells, k, exclude_self)[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["cell", "n"])
    return run


def _candidates(candidates: DataFrame, cid: str, vec: str, clabel: str | None) -> DataFrame:
    lab = F.col(clabel).cast("double") if clabel else F.lit(None).cast("double")
    return candidates.select(F.col(cid).cast("string").alias("cid"), F.col(vec).cast("array<double>").alias("vec"), lab.alias("clabel")).where("vec IS NOT NULL")


def _of_cell(values) -> "F.Column":
    """A whole number for each cell (at most SAMPLE_ROWS), by the row's cell."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)


def _meet(visits: DataFrame, cand: DataFrame, parts, fn, schema) -> DataFrame:
    """Cogroup of the visiting queries, each cell's in so many ``parts``, with the candidates of each visited block."""
    n = _of_cell(parts)
    q = visits.withColumn("_qb", F.pmod(F.xxhash64("qid"), n.cast("bigint")).cast("int"))
    c = cand.where(n > 0).withColumn("_qb", F.explode(F.sequence(F.lit(0), n - 1))).drop("pdist")
    return q.groupBy("cell", "block", "_qb").cogroup(c.groupBy("cell", "block", "_qb")).applyInArrow(fn, schema)


def _prepare(queries, candidates, k, qid, cid, vec, clabel, exclude_self, block_rows):
    """Candidates with their cell and block, the blocks that each query has to visit, and the number of parts of each cell's queries."""
    cand = _candidates(candidates, cid, vec, clabel)
    nc = cand.count()
    q = queries.select(F.col(qid).cast("string").alias("qid"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    if block_rows is None:
        block_rows = min(MAX_BLOCK_ROWS, max(DEFAULT_BLOCK_ROWS, math.isqrt(q.count() * nc // BLOCK_PAIRS)))
    sample = cand.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE_ROWS).select("cid", "vec").toArrow()  # SAMPLE_ROWS rows at most
    if not sample.num_rows:
        return None
    points, n_pivots = _matrix(sample.column("vec")), min(sample.num_rows, max(1, math.ceil(nc / block_rows)))
    cand = cand.mapInArrow(_nearest(points[:n_pivots]), T.StructType([*cand.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("pdist", T.DoubleType())]))
    radius, size = np.zeros(n_pivots), np.zeros(n_pivots, np.int64)
    for r in cand.groupBy("cell").agg(F.max("pdist").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row for each cell
        radius[r["cell"]], size[r["cell"]] = r["r"], r["n"]
    cells = _Cells(points, sample.column("cid").to_pylist(), radius, size, block_rows)
    placed = cand.withColumns({"block": F.pmod(F.xxhash64("cid"), _of_cell(cells.blocks).cast("bigint")).cast("int"), "chash": F.xxhash64("vec")})
    parts = np.zeros(n_pivots, np.int64)
    for r in q.mapInArrow(_visitors(cells, k, exclude_self), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row for each cell
        parts[r["cell"]] = -(-r["n"] // block_rows)
    visit = T.StructType([*q.schema.fields, T.StructField("bound", T.DoubleType()), T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType())])
    return placed, q.mapInArrow(_visits(cells, k, exclude_self), visit), parts


def visited_blocks(queries: DataFrame, candidates: DataFrame, k: int, qid: str, cid: str, vec: str,
                   exclude_self: bool = True, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(qid, n_blocks): how many candidate blocks each query is compared with."""
    got = _prepare(queries, candidates, k, qid, cid, vec, None, exclude_self, block_rows)
    if got is None:
        return queries.sparkSession.createDataFrame([], "qid string, n_blocks long")
    return got[1].groupBy("qid").agg(F.count(F.lit(1)).alias("n_blocks"))


def knn(queries: DataFrame, candidates: DataFrame, k: int, qid: str, cid: str, vec: str,
        clabel: str | None = None, exclude_self: bool = True, with_vectors: bool = False,
        block_rows: int | None = None) -> DataFrame:
    """Exact kNN. ``vec`` is an array<double> column on both sides.

    Returns (qid, cid, dist, clabel[, cvec], rank) with rank 1..k.
    ``exclude_self`` drops candidates whose id equals the query id. Query ids
    must be distinct. ``block_rows``: by the sizes of the two sides.
    """
    schema = "qid string, cid string, dist double, clabel double, chash long"
    got = _prepare(queries, candidates, k, qid, cid, vec, clabel, exclude_self, block_rows)
    if got is None:
        empty = queries.sparkSession.createDataFrame([], schema).drop("chash")
        return (empty.withColumn("cvec", F.lit(None).cast("array<double>")) if with_vectors else empty).withColumn("rank", F.lit(0))
    placed, visits, parts = got
    part = _meet(visits, placed, parts, _block_topk(k, exclude_self), schema)
    w = Window.partitionBy("qid").orderBy(F.col("dist").asc(), F.col("cid").asc())
    top = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not with_vectors:
        return top.drop("chash")
    # candidates' ids may repeat: one row for each id and vector
    v = (_candidates(candidates, cid, vec, None).select(F.col("cid").alias("_cid"), F.xxhash64("vec").alias("_chash"), F.col("vec").alias("cvec"))
         .groupBy("_cid", "_chash").agg(F.first("cvec").alias("cvec")).hint("merge"))
    return (top.join(v, F.col("cid").eqNullSafe(F.col("_cid")) & (F.col("chash") == F.col("_chash")))
            .select("qid", "cid", "dist", "clabel", "cvec", "rank"))
