"""V9 for trees: exact path-dependent Shapley values of forests and boosted trees.

A tree's value is the sum of its leaves, each a product over the features on its
path: feature j lets a row pass (1 or 0) or, where j is not known, a share of
the training rows (the product of the cover shares of j's splits). The Shapley
value of j in one leaf is value * (pass_j - share_j) times the integral over t in
[0, 1] of the product of share_k * (1 - t) + pass_k * t over the leaf's other
features: the weights of all subsets are those of a Beta integral. That is a
polynomial in t, so Gauss-Legendre nodes give it exactly (up to rounding).

Trees are read from the model's saved node table and sent to the tasks in groups
of bounded bytes; a task works on (rows, leaves, features) arrays of bounded size.
The trees of a ``ForestModel`` are walked instead (``walked``): leaves of one
branch share its product, so a node costs a few (rows, nodes of t) arrays, and
only for rows that a part of the tree tells apart.
"""

from __future__ import annotations

import itertools
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import ForestModel, share
from ..session import drop_path, scratch_path

#: Bytes of trees that one pass sends to the tasks, and cells of a (rows, leaves, features) array.
GROUP_BYTES, CELLS = 64 << 20, 1 << 20
#: Rows that walk through a tree at a time: the more, the more of them are of one kind. Splits of the parts whose kinds of rows are told apart, larger parts first.
WALK_ROWS, PARTS = 65_536, (24, 6)
#: Rows that a task of the forest's attributions gets, about, and tasks for each core where the rows are too few for that.
PART_ROWS, TASKS_PER_CORE = 49_152, 2
#: Codes of a table that numbers kinds of rows.
KIND_CODES = 1 << 16


@dataclass
class Leaves:
    """The leaves of some trees, a row each; features on a path are padded with feature -1, which every row passes."""
    value: np.ndarray     # (leaves,) contribution to the model's output
    feature: np.ndarray   # (leaves, m)
    low: np.ndarray       # a row passes if low < x <= high
    high: np.ndarray
    share: np.ndarray     # share of the cover that passes where the feature isn't known

    @property
    def base(self) -> float:
        """The expected output: each leaf by the share of the cover that reaches it."""
        return float((self.value * self.share.prod(axis=1)).sum())

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.value, self.feature, self.low, self.high, self.share))


def model_leaves(model) -> list[Leaves]:
    """The leaves of each tree of a fitted Spark forest, boosted-trees or tree model.

    A forest's output is the probability of class 1, that of boosted trees the
    log-odds (twice the margin). Only numeric splits are supported.
    """
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, f"trees-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    boosted = hasattr(model, "treeWeights") and "GBT" in type(model).__name__
    weights = [float(w) for w in model.treeWeights] if hasattr(model, "treeWeights") else [1.0]
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    # a model's node table, not data: it was fitted on the driver
    frame = nodes.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
                         F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("split.numCategories").alias("kinds")).toPandas()
    drop_path(spark, path)
    scale = 2.0 if boosted else 1.0 / sum(weights)
    return [_leaves(t.sort_values("id"), boosted, scale * weights[i]) for i, t in frame.groupby("treeID", sort=True)]


def _leaves(t: pd.DataFrame, boosted: bool, weight: float) -> Leaves:
    stats = t["impurityStats"].tolist()
    inner = t["leftChild"].to_numpy() >= 0
    if (t["kinds"].to_numpy()[inner] != -1).any():
        raise ValueError("only numeric splits have exact attributions here")
    cover = np.array([s[0] if boosted else sum(s) for s in stats], float)
    value = t["prediction"].to_numpy(float) if boosted else np.array([s[1] / sum(s) if len(s) > 1 else 0.0 for s in stats])
    left, right = t["leftChild"].to_numpy(), t["rightChild"].to_numpy()
    feature, cut = t["feature"].to_numpy(), [c[0] if len(c) else 0.0 for c in t["cut"]]
    place = {int(i): k for k, i in enumerate(t["id"])}
    paths, stack = [], [(0, {})]
    while stack:
        k, path = stack.pop()
        if not inner[k]:
            paths.append((value[k], path))
            continue
        j, x = int(feature[k]), cut[k]
        low, high, share = path.get(j, (-np.inf, np.inf, 1.0))
        for child, bounds in ((place[int(left[k])], (low, min(high, x))), (place[int(right[k])], (max(low, x), high))):
            stack.append((child, path | {j: (*bounds, share * cover[child] / cover[k])}))
    m = max(1, max(len(p) for _, p in paths))
    out = Leaves(np.array([v for v, _ in paths]) * weight, np.full((len(paths), m), -1), np.full((len(paths), m), -np.inf),
                 np.full((len(paths), m), np.inf), np.ones((len(paths), m)))
    for i, (_, path) in enumerate(paths):
        for c, (j, (low, high, share)) in enumerate(path.items()):
            out.feature[i, c], out.low[i, c], out.high[i, c], out.share[i, c] = j, low, high, share
    return out


def attributions(x: np.ndarray, trees: list[Leaves]) -> np.ndarray:
    """(rows, features): each feature's Shapley value in the sum of the trees."""
    out = np.zeros((x.shape[0], x.shape[1]))
    for tree in trees:
        m = tree.feature.shape[1]
        node, weight = np.polynomial.legendre.leggauss(m // 2 + 1)
        node, weight = (node + 1) / 2, weight / 2
        used = tree.feature.ravel() >= 0
        order = np.argsort(tree.feature.ravel()[used], kind="stable")
        named, first = np.unique(tree.feature.ravel()[used][order], return_index=True)
        step = max(1, CELLS // tree.feature.size)
        for a in range(0, len(x), step):
            own = x[a:a + step][:, np.maximum(tree.feature, 0)]
            passes = (own > tree.low) & (own <= tree.high)
            phi = np.zeros(passes.shape)
            for t, w in zip(node, weight):
                part = tree.share * (1 - t) + passes * t
                phi += (w * tree.value * part.prod(axis=2))[:, :, None] / part
            phi *= passes - tree.share
            if len(named):
                out[a:a + step, named] += np.add.reduceat(phi.reshape(len(own), -1)[:, used][:, order], first, axis=1)
    return out


def _most_features(t: dict) -> int:
    """The most features on a path of the tree."""
    most, stack = 1, [(0, frozenset())]
    while stack:
        node, seen = stack.pop()
        if t["feature"][node] < 0:
            most = max(most, len(seen))
        else:
            seen = seen | {int(t["feature"][node])}
            stack += [(int(t["left"][node]) + i, seen) for i in (0, 1)]
    return most


def _kinds(bits, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each kind of n rows, and each row's kind: rows that agree in all bits are of one kind."""
    kind, kinds, room = np.zeros(n, np.int64), 1, 1
    for bit in bits:
        kind <<= 1
        kind |= bit
        room *= 2
        if room > KIND_CODES:
            kind, kinds = _numbered(kind, room)
            room = kinds
            if 2 * kinds > n:
                break
    kind, kinds = _numbered(kind, room)
    first = np.empty(kinds, np.int64)
    first[kind[::-1]] = np.arange(n - 1, -1, -1)
    return first, kind


def _numbered(code: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """Codes below ``room`` as numbers from 0 without gaps."""
    there = np.zeros(room, np.int64)
    there[code] = 1
    number = there.cumsum()
    return number.take(code) - 1, int(number[-1])


class _Walk:
    """A tree and the Shapley values that its parts give to rows.

    What a part of a tree gives to a row depends only on which features of the path let the row pass and on which side of
    the part's cuts it is. So rows that agree in that are one: a part of at most ``PARTS[i]`` splits is worked out once for
    each kind of rows, and its kinds again for the smaller parts in it.
    """

    def __init__(self, tree: dict, scale: float):
        self.feature, self.left = tree["feature"].tolist(), tree["left"].tolist()
        # a cut's number among its feature's: rows are taken as numbers, too (``binned``)
        self.cuts_of = {j: np.unique(tree["cut"][tree["feature"] == j]) for j in set(self.feature) if j >= 0}
        self.cut = [int(np.searchsorted(self.cuts_of[j], c)) if j >= 0 else 0 for j, c in zip(self.feature, tree["cut"].tolist())]
        self.value, self.cover = (scale * share(tree)).tolist(), (tree["c0"] + tree["c1"]).tolist()
        t, w = np.polynomial.legendre.leggauss(_most_features(tree) // 2 + 1)
        self.t, self.w = (t + 1) / 2, w / 2
        self.splits = [0] * len(self.feature)
        for node in range(len(self.feature) - 1, -1, -1):  # children come after their node
            if self.feature[node] >= 0:
                self.splits[node] = 1 + self.splits[self.left[node]] + self.splits[self.left[node] + 1]

    def binned(self, x: np.ndarray) -> np.ndarray:
        """(features, rows): how many of its feature's cuts are below each value, so that x <= cut where this is at most the cut's number."""
        out = np.zeros((x.shape[1], len(x)), np.min_scalar_type(max(map(len, self.cuts_of.values()), default=0)))
        for j, cuts in self.cuts_of.items():
            out[j] = np.searchsorted(cuts, x[:, j])
        return out

    def sides(self, node: int, x: np.ndarray, path: dict):
        """Each child of a split: its path, with who passes the split's feature and its share."""
        j = self.feature[node]
        goes, (before, known) = x[j] <= self.cut[node], path.get(j, (None, 1.0))
        for child, passes in ((self.left[node], goes), (self.left[node] + 1, ~goes)):
            yield child, path | {j: (passes if before is None else passes & before, known * self.cover[child] / self.cover[node])}

    def cuts(self, node: int) -> set:
        """The (feature, cut) of a part's splits."""
        found, stack = set(), [node]
        while stack:
            node = stack.pop()
            if (j := self.feature[node]) >= 0:
                found.add((j, self.cut[node]))
                stack += (self.left[node], self.left[node] + 1)
        return found

    def add(self, node: int, x: np.ndarray, path: dict, phi: np.ndarray, level: int = 0) -> None:
        """Adds to phi (features, rows) what the leaves below a node give; path: who passes each feature so far, and its share."""
        if level == len(PARTS):
            self.leaves(node, x, path, phi)
        elif self.splits[node] > PARTS[level]:
            for child, below in self.sides(node, x, path):
                self.add(child, x, below, phi, level)
        else:
            cuts = sorted(self.cuts(node))
            first, kind = _kinds(itertools.chain((passes for passes, _ in path.values()), (x[j] <= cut for j, cut in cuts)), x.shape[1])
            if 2 * len(first) > x.shape[1]:
                self.add(node, x, path, phi, level + 1)
                return
            used, own, some = {*path, *(j for j, _ in cuts)}, np.zeros((len(phi), len(first))), np.empty((len(x), len(first)), x.dtype)
            for j, _ in cuts:
                some[j] = x[j].take(first)
            self.add(node, some, {j: (passes.take(first), known) for j, (passes, known) in path.items()}, own, level + 1)
            for j in used:
                phi[j] += own[j].take(kind)

    def leaves(self, node: int, x: np.ndarray, path: dict, phi: np.ndarray) -> None:
        """At a split by feature j the product of the branch changes by j's factor, share * (1 - t) + pass * t. What the leaves
        below add up to gives j its part with the new factor and takes back its part with the factor of j's split above."""
        every, t, w = np.arange(x.shape[1]), self.t, self.w

        def factors(known: float):
            no = known * (1 - t)
            return np.array([no, no + t]), np.array([-known / no, (1 - known) / (no + t)])

        def below(node: int, product: np.ndarray, path: dict) -> np.ndarray:
            if (j := self.feature[node]) < 0:
                return self.value[node] * product
            before, known = path.get(j, (None, 1.0))
            total = 0.0
            for child, under in self.sides(node, x, path):
                passes, part = under[j]
                factor, gain = factors(part)
                kind = passes.view(np.int8)
                if before is not None:
                    kind = kind + before.view(np.int8)  # passes neither, only above, both
                    old, taken = factors(known)
                    factor = np.array([factor[0] / old[0], factor[0] / old[1], factor[1] / old[1]])
                    gain = np.array([gain[0] - taken[0], gain[0] - taken[1], gain[1] - taken[1]])
                sums = below(child, product * factor.take(kind, axis=0), under)
                phi[j] += (sums @ (w * gain).T)[every, kind]
                total = total + sums
            return total

        product, gains = np.ones((len(every), len(t))), {}
        for j, (passes, known) in path.items():
            factor, gains[j] = factors(known)
            product *= factor.take(passes.view(np.int8), axis=0)
        total = below(node, product, path)
        for j, gain in gains.items():
            phi[j] += (total @ (w * gain).T)[every, path[j][0].view(np.int8)]


def walked(x: np.ndarray, trees: list[dict], scale: float) -> np.ndarray:
    """(rows, features): each feature's Shapley value in ``scale`` times the sum of the trees' shares of class 1."""
    out = np.zeros((x.shape[1], len(x)))
    for tree in trees:
        walk = _Walk(tree, scale)
        for a in range(0, len(x), WALK_ROWS):
            walk.add(0, walk.binned(x[a:a + WALK_ROWS]), {}, out[:, a:a + WALK_ROWS])
    return out.T


def base_value(model) -> float:
    """The output that the attributions of a row start from."""
    if isinstance(model, ForestModel):
        trees = [t for group in model.groups() for t in group]
        return sum(float((share(t) * (t["c0"] + t["c1"]))[t["feature"] < 0].sum() / (t["c0"][0] + t["c1"][0])) for t in trees) / len(trees)
    return sum(t.base for t in model_leaves(model))


def _groups(trees: list[Leaves]):
    """The trees in lists of bounded bytes."""
    group, size = [], 0
    for tree in trees:
        if group and size + tree.nbytes > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(tree)
        size += tree.nbytes
    if group:
        yield group


def tree_shapley(model, df: DataFrame, names, key: str = "row_id", vec: str = "features_arr") -> DataFrame:
    """row_id, feature, shap for every row of df: the values of a row add up to its output less ``base_value``.

    Rows must have distinct keys; a null vector gives no rows. Outputs as in ``model_leaves``.
    """
    spark, d = df.sparkSession, len(names)
    rows = df.select(F.col(key).alias("row_id"), F.col(vec).cast("array<double>").alias("x")).where("x IS NOT NULL")
    cores = spark.sparkContext.defaultParallelism
    if isinstance(model, ForestModel):
        return _named(_forest_values(model, rows, d, cores), names)
    if rows.rdd.getNumPartitions() < cores:  # a row costs far more here than a shuffle
        rows = rows.repartition(cores)
    kind = rows.schema["row_id"].dataType.simpleString()

    def one(trees: list[Leaves]) -> DataFrame:
        sent = spark.sparkContext.broadcast(trees)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    phi = np.ascontiguousarray(attributions(batch.column("x").flatten().to_numpy().reshape(-1, d), sent.value))
                    ends = np.arange(0, phi.size + 1, d, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(phi.ravel()))], ["row_id", "phi"])

        return rows.mapInArrow(run, f"row_id {kind}, phi array<double>")

    parts = [one(g) for g in _groups(model_leaves(model))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.withColumnRenamed("phi", "_phi"), "row_id").select("row_id", F.zip_with("phi", "_phi", lambda a, b: a + b).alias("phi"))
    return _named(out, names)


def _named(values: DataFrame, names) -> DataFrame:
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("phi").alias("shap"))
    return values.select("row_id", F.inline(named).alias("feature", "shap"))


def _forest_values(model: ForestModel, rows: DataFrame, d: int, cores: int) -> DataFrame:
    """row_id and phi of all rows. A task walks many rows, of which many are of one kind, through some of the trees; their values are added up for each row."""
    spark, scale, kind = rows.sparkSession, 1.0 / model.n_trees, rows.schema["row_id"].dataType.simpleString()
    n = math.ceil(rows.count() / PART_ROWS)
    rows = rows.withColumn("_n", F.monotonically_increasing_id())

    def one(trees: list[dict]) -> DataFrame:
        copies = max(1, min(len(trees), math.ceil(TASKS_PER_CORE * cores / max(n, 1))))
        sent = spark.sparkContext.broadcast(trees)

        def run(table: pa.Table) -> pa.Table:
            x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
            phi = np.ascontiguousarray(walked(x, sent.value[table.column("_copy")[0].as_py()::copies], scale))
            ends = np.arange(0, phi.size + 1, d, dtype=np.int32)
            return pa.table({"_n": table.column("_n"), "row_id": table.column("row_id"), "phi": pa.ListArray.from_arrays(pa.array(ends), pa.array(phi.ravel()))})

        dealt = rows.withColumns({"_part": F.pmod(F.xxhash64("_n"), F.lit(max(n, 1))), "_copy": F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))})
        dealt = dealt.repartition(4 * max(n, 1) * copies, "_part", "_copy")  # more parts than groups, so that few share one
        return dealt.groupBy("_part", "_copy").applyInArrow(run, f"_n long, row_id {kind}, phi array<double>")

    parts = [one(g) for g in model.groups()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = every.groupBy("_n").agg(F.first("row_id").alias("row_id"), *[F.sum(F.col("phi")[j]).alias(f"_s{j}") for j in range(d)])
    return sums.select("row_id", F.array(*[f"_s{j}" for j in range(d)]).alias("phi"))
