"""L4 with class weights, focal loss and early stopping: a feed-forward network trained by Spark.

Rows are packed once into blocks that depend only on the rows' ids; a block
belongs to one mini-batch. In a round every block of a mini-batch gives its
gradient in fixed point, Spark adds the blocks up (whole numbers, so in any
order), and the driver, which holds the weights (bounded by the layers), takes
an Adam step. So neither partitioning nor retries change the result. Each epoch
ends with the loss on the validation rows and writes the state; a run that is
given the same folder goes on from the last epoch written.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .models import FEATURES, HIDDEN_LAYERS, LABEL, WEIGHT

#: Rows in a block on average, values of a piece of the gradient that is added up by one task, and steps of fixed point in 1.
BLOCK_ROWS, PIECE, FIXED = 4096, 1 << 16, 2.0 ** 32
#: Partitions whose pieces one task adds up.
FEW = 64
# The loss' weight of a row by mode, its exponent, and the optimiser's settings.
FOCAL_ALPHA, GAMMA = {"recall": 0.75, "precision": 0.25}, 2.0
STEP, DECAY, CLIP = 0.001, 1e-4, 1.0
PLATEAU, SHRINK = 5, 0.5


class Network:
    """Weights of a network with rectified hidden layers and one output, in one flat array."""

    def __init__(self, sizes: tuple[int, ...], flat: np.ndarray | None = None, seed: int = 123):
        self.sizes = tuple(sizes)
        if flat is None:
            rng = np.random.Generator(np.random.PCG64(seed))
            flat = np.concatenate([np.concatenate([rng.normal(0, math.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in zip(sizes[:-1], sizes[1:])])
        self.flat = flat

    def layers(self, flat: np.ndarray):
        at = 0
        for a, b in zip(self.sizes[:-1], self.sizes[1:]):
            yield flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]
            at += a * b + b

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The values of each layer; the last are log-odds."""
        out, layers = [x], list(self.layers(self.flat))
        for i, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
        return out

    def loss(self, x, y, w, alpha: float, with_gradient: bool = True) -> tuple[float, np.ndarray | None]:
        """The weighted sum over rows of the focal loss, and its gradient."""
        values = self.forward(x)
        z = values[-1][:, 0]
        bce = np.logaddexp(0.0, z) - y * z
        miss = -np.expm1(-bce)  # 1 - the probability of the true class
        total = float((w * alpha * miss ** GAMMA * bce).sum())
        if not with_gradient:
            return total, None
        slope = alpha * (miss ** GAMMA + GAMMA * miss ** (GAMMA - 1) * (1 - miss) * bce)
        back = (w * slope * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y))[:, None]
        grad = np.zeros_like(self.flat)
        pairs = list(zip(self.layers(self.flat), self.layers(grad)))
        for i in range(len(pairs) - 1, -1, -1):
            (weight, _), (gw, gb) = pairs[i]
            gw[:], gb[:] = values[i].T @ back, back.sum(0)
            if i:
                back = (back @ weight.T) * (values[i] > 0)
        return total, grad


def packed_rows(df: DataFrame, key: str, vec: str, label: str, weight: str | None, name: str, batches: int = 1) -> DataFrame:
    """Blocks (block, n, x, y, w, batch) of about BLOCK_ROWS rows by a hash of the key, each sorted by key; written once.

    Each mini-batch (block modulo ``batches``) has a folder of its own, so that a pass over one reads no other. Rows need distinct keys, a label 0 or 1 and a vector of one length without nulls.
    """
    n = df.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    rows = df.select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(blocks)).cast("int").alias("block"), F.col(key).cast("string").alias("id"),
                     F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        values = [t.column("x").combine_chunks().flatten().to_numpy().tobytes(), *(t.column(c).to_numpy().tobytes() for c in ("y", "w"))]
        return pa.table({"block": t.column("block").slice(0, 1), "n": pa.array([t.num_rows], pa.int32()), **{c: pa.array([v], pa.binary()) for c, v in zip("xyw", values)}})

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    packed = rows.groupBy("block").applyInArrow(pack, "block int, n int, x binary, y binary, w binary")
    packed.withColumn("batch", F.pmod("block", F.lit(batches))).write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.parquet(path)


def _total(blocks: DataFrame, net: Network, alpha: float, with_gradient: bool, lanes: int) -> tuple[float, float, np.ndarray]:
    """Sum of the loss, of the weights, and of the gradient, over all blocks."""
    sizes, flat = net.sizes, net.flat

    def run(batches):
        own, total = Network(sizes, flat), None
        for batch in batches:
            for n, x, y, w in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y", "w"))):
                w = np.frombuffer(w)
                loss, grad = own.loss(np.frombuffer(x).reshape(n, sizes[0]), np.frombuffer(y), w, alpha, with_gradient)
                part = np.rint(np.concatenate([[loss, w.sum()], grad if with_gradient else []]) * FIXED).astype(np.int64)
                total = part if total is None else total + part
        if total is not None:
            pieces = [total[i:i + PIECE] for i in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "v"])

    def add(t: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(v, np.int64) for v in t.column("v").to_pylist())
        return pa.table({"piece": t.column("piece").slice(0, 1), "v": pa.array([out.tobytes()], pa.binary())})

    parts = blocks.select("n", "x", "y", "w").mapInArrow(run, "piece int, v binary")
    if lanes > 1:  # so that no task adds up the pieces of all partitions
        lane = F.pmod(F.spark_partition_id(), F.lit(lanes))
        parts = parts.withColumn("lane", lane).groupBy("piece", "lane").applyInArrow(lambda t: add(t), "piece int, v binary")
    got = parts.groupBy("piece").applyInArrow(add, "piece int, v binary").toArrow().sort_by("piece")  # the gradient
    total = np.concatenate([np.frombuffer(v, np.int64) for v in got.column("v").to_pylist()]).astype(np.float64) / FIXED
    return total[0], total[1], total[2:]


def focal_network(train: DataFrame, validation: DataFrame, n_features: int, hidden=HIDDEN_LAYERS, mode: str = "recall", epochs: int = 200,
                  batches: int = 8, patience: int = 10, seed: int = 123, weight_col: str | None = WEIGHT, key: str = "row_id",
                  vec: str = "features_arr", label: str = LABEL, state: str | None = None) -> "NetworkModel":
    """L4: trained on rows as they are (unbalanced), with class weights in ``weight_col`` and the focal loss of the mode.

    ``batches`` mini-batches make an epoch. The step halves after PLATEAU epochs
    without a lower validation loss, and training stops after ``patience`` of them;
    the weights of the best epoch are the model's. ``state`` names a folder for
    the epochs' states (default: a new one); a folder that has some is gone on from.
    Of the reference's layers, drop-out and batch normalisation are left out.
    """
    spark = train.sparkSession
    weight_col = weight_col if weight_col in train.columns else None
    blocks = packed_rows(train, key, vec, label, weight_col, "network-rows", batches)
    held = packed_rows(validation, key, vec, label, weight_col if weight_col in validation.columns else None, "network-validation")
    state = state or scratch_path(spark, f"network-{uuid.uuid4().hex}")
    alpha = FOCAL_ALPHA[mode]
    lanes = math.isqrt(max(blocks.rdd.getNumPartitions(), held.rdd.getNumPartitions()) // FEW)
    some = {r[0] for r in blocks.select("batch").distinct().collect()}  # small tables have fewer blocks than mini-batches
    net = Network((n_features, *hidden, 1), seed=seed)
    now = _read(spark, state) or {"epoch": 0, "t": 0, "step": STEP, "flat": net.flat, "m": np.zeros_like(net.flat), "v": np.zeros_like(net.flat),
                                  "best": net.flat, "best_loss": math.inf, "bad": 0}
    while now["epoch"] < epochs and now["bad"] < patience:
        for b in sorted(some):
            net.flat = now["flat"]
            _, weight, grad = _total(blocks.where(F.col("batch") == b), net, alpha, True, lanes)
            grad = grad / weight + DECAY * net.flat
            grad *= min(1.0, CLIP / (np.sqrt((grad * grad).sum()) + 1e-12))
            now["t"] += 1
            now["m"], now["v"] = 0.9 * now["m"] + 0.1 * grad, 0.999 * now["v"] + 0.001 * grad * grad
            now["flat"] = net.flat - now["step"] * (now["m"] / (1 - 0.9 ** now["t"])) / (np.sqrt(now["v"] / (1 - 0.999 ** now["t"])) + 1e-8)
        net.flat = now["flat"]
        loss, weight, _ = _total(held, net, alpha, False, lanes)
        loss /= weight or 1.0
        if loss < now["best_loss"]:
            now |= {"best": now["flat"], "best_loss": loss, "bad": 0}
        else:
            now["bad"] += 1
            if now["bad"] % PLATEAU == 0:
                now["step"] *= SHRINK
        now["epoch"] += 1
        _write(spark, state, now)
    return NetworkModel(Network(net.sizes, now["best"]), now["epoch"], now["best_loss"])


def _write(spark: SparkSession, state: str, now: dict) -> None:
    held = io.BytesIO()
    np.savez(held, **now)
    spark.createDataFrame([(now["epoch"], held.getvalue())], "epoch int, state binary").coalesce(1).write.mode("overwrite").parquet(f"{state}/epoch={now['epoch']}")


def _read(spark: SparkSession, state: str) -> dict | None:
    """The last epoch's state, if the folder has any."""
    where = spark._jvm.org.apache.hadoop.fs.Path(state)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    epochs = [int(n.partition("=")[2]) for n in found if n.startswith("epoch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{n}/_SUCCESS"))]
    if not epochs:
        return None
    held = spark.read.parquet(f"{state}/epoch={max(epochs)}").select("state").first()[0]
    got = dict(np.load(io.BytesIO(bytes(held))))
    return {k: v if v.ndim else v.item() for k, v in got.items()}


class NetworkModel:
    """A trained network with the interface of Spark's models: ``transform`` adds probability and prediction."""

    def __init__(self, network: Network, epochs: int = 0, validation_loss: float = math.nan):
        self.network, self.epochs, self.validation_loss = network, epochs, validation_loss

    def transform(self, df: DataFrame) -> DataFrame:
        sizes, sent = self.network.sizes, df.sparkSession.sparkContext.broadcast(self.network.flat)

        @F.pandas_udf("double")
        def positive(rows: pd.Series) -> pd.Series:
            z = Network(sizes, sent.value).forward(np.vstack(rows.to_numpy()))[-1][:, 0] if len(rows) else np.zeros(0)
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

        out = df.withColumn("_network_p", positive(vector_to_array(FEATURES)))
        return out.withColumns({"probability": array_to_vector(F.array(F.lit(1.0) - F.col("_network_p"), F.col("_network_p"))),
                                "prediction": (F.col("_network_p") > 0.5).cast("double")}).drop("_network_p")

    def write(self) -> "NetworkWriter":
        return NetworkWriter(self)

    @classmethod
    def load(cls, path: str) -> "NetworkModel":
        row = SparkSession.getActiveSession().read.parquet(f"{path}/network").first()
        return cls(Network(tuple(row["sizes"]), np.frombuffer(bytes(row["weights"])).copy()), row["epochs"], row["loss"])


class NetworkWriter(MLWriter):
    def __init__(self, model: NetworkModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        row = (list(m.network.sizes), m.network.flat.tobytes(), m.epochs, float(m.validation_loss))
        self.sparkSession.createDataFrame([row], "sizes array<int>, weights binary, epochs int, loss double").coalesce(1).write.parquet(f"{path}/network")
