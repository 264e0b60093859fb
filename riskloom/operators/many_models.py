"""Many logistic regressions in the passes of one.

All models of a task list (grid points, folds, feature sets) are columns of one
coefficient block. A pass computes the loss and gradient of every model at its
next trial point with two matrix products per block of rows; Spark sums them.
The driver holds the block (models x features) and runs, for each model by
itself, the same limited-memory quasi-Newton steps with orthant projection for
l1 penalties, so a model's path doesn't depend on the others. The number of
passes is that of the slowest model.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, rows_of_blocks, scratch_path

#: Rows in a packed block, and values of a piece of a pass's sums that is added up by one task.
BLOCK_ROWS, PIECE = 4096, 1 << 16
#: Blocks in a file: small files are dealt evenly over the tasks of a pass, and a reader holds no more of them.
FILE_BLOCKS = 8
#: Rows whose margins with all models are held at a time, so that they stay in a core's cache.
SLICE = 512
#: Past steps that shape the next one, and the share of the predicted gain that a step has to bring.
MEMORY, GAIN = 10, 1e-4


@dataclass(frozen=True)
class Task:
    """One model: penalty weight ``reg`` (l1 share ``l1``) of the mean weighted loss, the fold it doesn't see, the features it may use (None: all)."""
    reg: float = 0.0
    l1: float = 0.0
    leave_out: int | None = None
    features: tuple[int, ...] | None = None


class Blocks:
    """Training rows as packed matrix blocks in the shared folder; ``close`` deletes them."""

    def __init__(self, df: DataFrame, vec: str = "features_arr", label: str = "label", weight: str | None = "weight", fold: str | None = "fold"):
        """Rows need a vector of one length without nulls, a label 0 or 1, and, where named, a weight and a fold number."""
        spark = self.spark = df.sparkSession
        cols = [F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"),
                (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold")]
        self.path = scratch_path(spark, f"blocks-{uuid.uuid4().hex}")

        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK_ROWS):
                    b = batch.slice(i, BLOCK_ROWS)
                    if fold:  # a fold's rows of a block lie together
                        b = b.take(pa.array(np.argsort(b.column("fold").to_numpy(), kind="stable")))
                    yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (
                        b.column("x").flatten().to_numpy(), b.column("y").to_numpy(), b.column("w").to_numpy(), b.column("fold").to_numpy())]], ["n", "x", "y", "w", "fold"])

        df.select(*cols).mapInArrow(run, "n int, x binary, y binary, w binary, fold binary").write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(self.path)
        self.rows = spark.read.parquet(self.path)
        first = self.rows.select("n", F.octet_length("x").alias("b")).where("n > 0").first()
        if first is None:
            raise ValueError("no rows to fit")
        self.d = first["b"] // 8 // first["n"]

    def sums(self, fn, size: int) -> np.ndarray:
        """The element-wise sum, over all blocks, of the ``size`` values that fn(x, y, w, fold) gives."""
        d = self.d

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for n, x, y, w, fold in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y", "w", "fold"))):
                    total += fn(np.frombuffer(x).reshape(n, d), np.frombuffer(y), np.frombuffer(w), np.frombuffer(fold, np.int32))
            pieces = [total[i:i + PIECE] for i in range(0, size, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "v"])

        def add(t: pa.Table) -> pa.Table:
            out = sum(np.frombuffer(v) for v in t.column("v").to_pylist())
            return pa.table({"piece": t.column("piece").slice(0, 1), "v": pa.array([out.tobytes()], pa.binary())})

        parts = self.rows.mapInArrow(run, "piece int, v binary")
        with rows_of_blocks(self.spark):
            got = parts.groupBy("piece").applyInArrow(add, "piece int, v binary").toArrow().sort_by("piece")  # ``size`` values
        return np.concatenate([np.frombuffer(v) for v in got.column("v").to_pylist()]) if got.num_rows else np.zeros(size)

    def close(self) -> None:
        drop_path(self.spark, self.path)


class _Path:
    """One model's descent: asks for a point, takes its loss and gradient."""

    def __init__(self, task: Task, d: int, max_iter: int, tol: float):
        self.task, self.max_iter, self.tol = task, max_iter, tol
        self.free = np.ones(d + 1, bool)
        if task.features is not None:
            self.free[:d] = False
            self.free[list(task.features)] = True
        self.l1 = np.append(np.full(d, task.reg * task.l1), 0.0)
        self.l2 = np.append(np.full(d, task.reg * (1 - task.l1)), 0.0)
        self.x = self.trial = np.zeros(d + 1)
        self.loss, self.steps, self.done, self.size, self.n = math.inf, [], False, 1.0, 0
        self.direction = None

    def pseudo(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The steepest slope where the l1 term has a corner."""
        right, left = g + self.l1, g - self.l1
        at_zero = np.where(right < 0, right, np.where(left > 0, left, 0.0))
        return np.where(x > 0, right, np.where(x < 0, left, at_zero))

    def take(self, loss: float, grad: np.ndarray) -> None:
        grad = (grad + self.l2 * self.trial) * self.free
        loss = loss + float((self.l1 * np.abs(self.trial)).sum() + (self.l2 * self.trial ** 2).sum() / 2)
        if self.direction is not None and loss > self.loss + GAIN * float(self.slope @ (self.trial - self.x)) and self.size > 1e-10:
            self.size /= 2
            self._try()
            return
        if self.direction is not None:
            s, y = self.trial - self.x, grad - self.grad
            if s @ y > 1e-14:
                self.steps = [*self.steps[1 - MEMORY:], (s, y)]
            self.n += 1
            gain = (self.loss - loss) / max(abs(self.loss), abs(loss), 1e-12)
            self.done = self.n >= self.max_iter or gain < self.tol
            if loss > self.loss:
                self.done = True
                return
        self.x, self.loss, self.grad = self.trial, loss, grad
        self.slope = self.pseudo(self.x, grad) * self.free
        if not np.abs(self.slope).max() > 1e-12:
            self.done = True
        if self.done:
            return
        q, back = self.slope.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            back.append(a)
        if self.steps:
            s, y = self.steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.steps, reversed(back)):
            q += s * (a - (y @ q) / (s @ y))
        step = -q * self.free
        step[(step * self.slope >= 0) & (self.l1 > 0)] = 0.0
        self.direction = step
        self.size = 1.0 if self.steps else min(1.0, 1.0 / float(np.abs(self.slope).sum()))
        self._try()

    def _try(self) -> None:
        trial = self.x + self.size * self.direction
        side = np.where(self.x != 0, np.sign(self.x), -np.sign(self.slope))
        self.trial = np.where((self.l1 > 0) & (trial * side < 0), 0.0, trial)


def fit_many(blocks: Blocks, tasks: list[Task], max_iter: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, int]:
    """Coefficients with the intercept last (models, features + 1), and the number of passes over the blocks.

    Each model minimises its weighted mean log loss plus its penalty (the
    intercept has none); it stops when a step gains less than a share ``tol``.
    """
    d = blocks.d
    paths = [_Path(t, d, max_iter, tol) for t in tasks]
    out_fold = np.array([-2 if t.leave_out is None else t.leave_out for t in tasks])
    folds = np.unique(out_fold)

    def weights(x, y, w, fold):
        return np.array([w[fold != f].sum() for f in folds])

    total = dict(zip(folds.tolist(), blocks.sums(weights, len(folds))))
    passes = 1
    while open_ := [i for i, p in enumerate(paths) if not p.done]:
        at = np.array([paths[i].trial for i in open_])
        out = out_fold[open_]

        by = np.argsort(out, kind="stable")  # a fold's models lie together, too
        ends = {f: (np.searchsorted(out[by], f), np.searchsorted(out[by], f, "right")) for f in folds.tolist()}
        slopes, starts = at[by, :-1].T.copy(), at[by, -1]

        def run(x, y, w, fold):
            loss, grad, shift = np.zeros(len(by)), np.zeros((len(by), d)), np.zeros(len(by))
            for i in range(0, len(y), SLICE):
                rows, real, weight, seen_by = x[i:i + SLICE], y[i:i + SLICE, None], w[i:i + SLICE, None], fold[i:i + SLICE]
                margin = rows @ slopes
                margin += starts
                less = np.exp(-np.abs(margin))
                cost = np.log1p(less)
                cost += np.maximum(margin, 0.0)
                cost -= real * margin
                left = np.where(margin >= 0, 1.0, less)
                less += 1.0
                left /= less
                left -= real
                for part in (cost, left):
                    part *= weight
                    for f in np.unique(seen_by).tolist():
                        a, z = ends.get(f, (0, 0))
                        part[np.searchsorted(seen_by, f):np.searchsorted(seen_by, f, "right"), a:z] = 0.0
                loss += cost.sum(0)
                grad += left.T @ rows
                shift += left.sum(0)
            back = np.argsort(by)
            return np.concatenate([loss[back], grad[back].ravel(), shift[back]])

        got = blocks.sums(run, len(open_) * (d + 2))
        passes += 1
        k = len(open_)
        for j, i in enumerate(open_):
            n = total[int(out[j])] or 1.0
            grad = np.append(got[k + j * d:k + (j + 1) * d], got[k + k * d + j])
            paths[i].take(got[j] / n, grad / n)
    return np.array([p.x for p in paths]), passes


def confusion_many(blocks: Blocks, coefficients: np.ndarray, on_fold: list[int | None]) -> np.ndarray:
    """(models, 3): true positives, false positives and false negatives of each model on its fold (None: on all rows), in one pass.

    A row is taken for positive where its probability is above one half; rows count once, whatever their weight.
    """
    at = np.array([-2 if f is None else f for f in on_fold])

    def run(x, y, w, fold):
        said = x @ coefficients[:, :-1].T + coefficients[:, -1] > 0
        seen = (at == -2) | (fold[:, None] == at)
        real = (y == 1)[:, None]
        return np.concatenate([(seen & said & real).sum(0), (seen & said & ~real).sum(0), (seen & ~said & real).sum(0)]).astype(float)

    return blocks.sums(run, 3 * len(at)).reshape(3, -1).T


def grid_search_many(train: DataFrame, grid: list[tuple[float, float]], k: int = 5, max_iter: int = 200, tol: float = 1e-6):
    """For each (reg, l1 share) the mean F1 over k folds, the models of all rows, and the number of passes.

    ``train`` has features_arr, label, weight and fold (0 to k - 1). All folds of
    all points and the fits on all rows are one task list.
    """
    blocks = Blocks(train)
    try:
        tasks = [Task(r, a, f) for r, a in grid for f in [*range(k), None]]
        fitted, passes = fit_many(blocks, tasks, max_iter, tol)
        held = [i for i, t in enumerate(tasks) if t.leave_out is not None]
        tp, fp, fn = confusion_many(blocks, fitted[held], [tasks[i].leave_out for i in held]).T
        f1 = np.divide(2 * tp, 2 * tp + fp + fn, out=np.zeros_like(tp), where=2 * tp + fp + fn > 0).reshape(len(grid), k)
        whole = fitted[[i for i, t in enumerate(tasks) if t.leave_out is None]]
        return f1.mean(axis=1), whole, passes + 1
    finally:
        blocks.close()
