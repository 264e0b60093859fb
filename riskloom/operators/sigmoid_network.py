"""L4: Spark's feed-forward network (sigmoid layers, softmax on top), its passes as matrix products.

Objective, start and descent are those of MultilayerPerceptronClassifier: the mean over
stacks of ``block_size`` rows of a stack's mean log loss, Spark's own first weights for the
seed, and a limited-memory quasi-Newton descent with a strong Wolfe line search. A pass over
packed row blocks gives loss and gradient; Spark adds them up, and the driver holds the
weights (bounded by the layers). The fitted weights are given back to Spark's class, so the
result is Spark's model.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .many_models import BLOCK_ROWS, Blocks
from .network import Network

#: Past steps that shape the next one, and the trials of a line search and of its narrowing.
MEMORY, TRIALS = 10, 10
#: The least gain and the slope's decrease that a step has to bring, and the losses that are compared for an end.
GAIN, CURVE, LAST = 1e-4, 0.9, 20
#: Rows whose layers are held at a time, so that they stay in a core's cache.
SLICE = 256


def loss_and_gradient(net: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weighted sum over rows of the log loss, and then its gradient."""
    return sum((_slice(net, *(v[i:i + SLICE] for v in (x, y, w))) for i in range(0, len(y), SLICE)), np.zeros(1 + len(net.flat)))


def _slice(net: Network, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    pairs, values = list(net.layers(net.flat)), [x]
    for i, (weight, b) in enumerate(pairs):
        z = values[-1] @ weight
        z += b
        if i + 1 < len(pairs):  # the sigmoid, as a hyperbolic tangent
            z *= 0.5
            np.tanh(z, out=z)
            z *= 0.5
            z += 0.5
        values.append(z)
    z = values[-1] - values[-1].max(1, keepdims=True)
    p = np.exp(z)
    total = p.sum(1, keepdims=True)
    rows, real = np.arange(len(y)), y.astype(np.int64)
    loss = float((w * (np.log(total[:, 0]) - z[rows, real])).sum())
    back = p / total
    back[rows, real] -= 1.0
    back *= w[:, None]
    out = np.empty(1 + len(net.flat))
    out[0], into = loss, list(net.layers(out[1:]))
    for i in range(len(pairs) - 1, -1, -1):
        gw, gb = into[i]
        gw[:], gb[:] = values[i].T @ back, back.sum(0)
        if i:
            back = back @ pairs[i][0].T
            back *= values[i] * (1.0 - values[i])
    return out


def stacked(df: DataFrame, features: str, label: str, block_size: int) -> DataFrame:
    """(x, y, w): a partition's rows in their order, each weighing one by the rows of its stack."""
    def run(batches):
        left, last = None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            left, last = (pa.concat_tables([left, t]) if left is not None else t), t.schema
            whole = left.num_rows // block_size * block_size
            for i in range(0, whole, max(1, BLOCK_ROWS // block_size) * block_size):
                part = left.slice(i, min(max(1, BLOCK_ROWS // block_size) * block_size, whole - i)).combine_chunks()
                yield from part.append_column("w", pa.array(np.full(part.num_rows, 1.0 / block_size))).to_batches()
            left = left.slice(whole)
        if left is not None and left.num_rows:
            yield from left.combine_chunks().append_column("w", pa.array(np.full(left.num_rows, 1.0 / left.num_rows))).to_batches()

    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(run, "x array<double>, y double, w double")


class _Stuck(Exception):
    """No step along this direction."""


def _between(a, b) -> float:
    """The least point of the cubic through two (t, loss, slope), kept off both ends."""
    d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
    inner = d1 * d1 - a[2] * b[2]
    wide = b[0] - a[0]
    if inner >= 0 and (under := b[2] - a[2] + 2 * math.sqrt(inner)) != 0:
        t = b[0] - wide * (b[2] + math.sqrt(inner) - d1) / under
    else:
        t = math.nan
    return a[0] + 0.1 * wide if t < a[0] + 0.1 * wide else a[0] + 0.9 * wide if t > a[0] + 0.9 * wide else t


def _step_size(at, first: float) -> float:
    """A step that meets the strong Wolfe conditions; at(t) gives (t, loss, slope)."""
    start = low = at(0.0)
    if start[2] > 0:
        raise _Stuck

    def narrowed(low, high) -> float:
        for _ in range(TRIALS):
            c = at(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > start[1] + GAIN * c[0] * start[2] or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= CURVE * abs(start[2]):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Stuck

    t = first
    for i in range(TRIALS):
        c = at(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > start[1] + GAIN * t * start[2] or (c[1] >= low[1] and i > 0):
            return narrowed(low, c)
        if abs(c[2]) <= CURVE * abs(start[2]):
            return t
        if c[2] >= 0:
            return narrowed(c, low)
        low, t = c, t * 1.5
    raise _Stuck


def _direction(grad: np.ndarray, steps: list) -> np.ndarray:
    """The quasi-Newton direction from the past steps, the last one first."""
    out, back = grad.copy(), []
    for s, g in steps:
        back.append((s @ out) / (s @ g))
        out -= back[-1] * g
    if steps:
        s, g = steps[0]
        if not s @ g >= 0:
            raise _Stuck
        out *= (s @ g) / (g @ g)
    for (s, g), a in zip(reversed(steps), reversed(back)):
        out += s * (a - (g @ out) / (s @ g))
    return -out


def descend(objective, x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """The point reached from x in at most max_iter steps; objective(x) gives (loss, gradient).

    Ends where the last losses or the gradient differ from the greatest of them, or from 0, by no
    more than a share ``tol``, or where no step is found, also without the past steps.
    """
    known: tuple = (None, None)

    def value(point):
        nonlocal known
        if known[0] is None or not np.array_equal(known[0], point):
            known = (point, objective(point))
        return known[1]

    loss, grad = value(x)
    begun, losses, steps, n, failed = abs(loss), [], [], 0, False
    while n < max_iter and not (len(losses) >= 2 and abs(loss - max(losses)) <= tol * begun) and np.linalg.norm(grad) > max(tol * abs(loss), 1e-8):
        try:
            way = _direction(grad, steps)

            def at(t):
                f, g = (loss, grad) if t == 0 else value(x + way * t)
                return t, f, float(g @ way)

            t = _step_size(at, 1.0 / np.linalg.norm(way) if n == 0 else 1.0)
            if t * np.linalg.norm(grad) < 1e-10:
                raise _Stuck
        except _Stuck:
            if failed:
                break
            failed, steps = True, []
            continue
        new = x + way * t
        new_loss, new_grad = value(new)
        steps = [(new - x, new_grad - grad), *steps][:MEMORY]
        x, loss, grad, n, failed = new, new_loss, new_grad, n + 1, False
        losses = [*losses, loss][-LAST:]
    return x


def fit(mlp: MultilayerPerceptronClassifier, rows: DataFrame):
    """What mlp.fit(rows) gives, for labels 0 and up, with the passes over packed blocks."""
    features, label, sizes = mlp.getFeaturesCol(), mlp.getLabelCol(), tuple(mlp.getLayers())
    zeros = rows.sparkSession.range(1).select(array_to_vector(F.array_repeat(F.lit(0.0), sizes[0])).alias(features), F.lit(0.0).alias(label))
    still = {mlp.maxIter: 0}
    first = mlp.fit(zeros, still).weights.toArray()  # of this seed, before any step
    blocks = Blocks(stacked(rows, features, label, mlp.getBlockSize()), "x", "y", "w", None)
    try:
        n = blocks.sums(lambda x, y, w, fold: np.array([w.sum()]), 1)[0]

        def objective(flat):
            got = blocks.sums(lambda x, y, w, fold: loss_and_gradient(Network(sizes, flat), x, y, w), len(flat) + 1) / n
            return got[0], got[1:]

        weights = descend(objective, first, mlp.getMaxIter(), mlp.getTol())
    finally:
        blocks.close()
    return mlp.fit(zeros, still | {mlp.initialWeights: Vectors.dense(weights)})
