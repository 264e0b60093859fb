"""Class-weighted Spark ML classifiers, stratified-fold grid search,
and batch scoring into the long score table (row_id, label, model, proba).

Parameter mapping from the reference's estimators:
* logistic regression: C -> regParam = 1 / (C * sum of weights); l1/l2 ->
  elasticNetParam 1/0; inputs are already standardised (standardization=False).
* random forest: a maxDepth above Spark's limit of 30 is refused; "min samples split" has no Spark
  twin and becomes minInstancesPerNode.
* boosted trees: scale_pos_weight becomes the positive-class row weight.
* feed-forward network: Spark's MLP has sigmoid hidden layers and no row
  weights, so it is trained on rebalanced rows.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.classification import (LogisticRegression, RandomForestClassifier,
                                       GBTClassifier, MultilayerPerceptronClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array, array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import hash_rank

LABEL = "label"
FEATURES = "features"
WEIGHT = "weight"
MAX_TREE_DEPTH = 30
#: Rows up to which Spark's own trainer grows a forest.
SPARK_FOREST_ROWS = 10_000
# Hidden layers of the network, and the tuning grids.
HIDDEN_LAYERS = (1024, 512, 256, 128, 64)
LR_CS, LR_PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), ("l1", "l2")
RF_TREES, RF_DEPTHS, RF_MIN_INSTANCES = (300, 500, 800, 1000), (20, 30), (1, 2)
GBT_DEPTHS, GBT_STEPS, GBT_ROUNDS = (5, 7, 10), (0.01, 0.1, 0.3), (100, 200, 300)
GBT_SUBSAMPLES, GBT_COLUMNS = (0.8, 1.0), ("0.8", "all")


# Iterative trainers pass over their input many times. It is kept first, and the
# kept rows are read in partitions of up to so many rows, so that a small input
# doesn't pay for idle tasks in every iteration; nothing above is narrowed. Every
# task of every pass reports to the driver, so past so many partitions a core
# they take more rows instead, up to MAX_ROWS_PER_PARTITION.
ROWS_PER_PARTITION, MAX_ROWS_PER_PARTITION, PARTITIONS_PER_CORE = 100_000, 2_000_000, 2


def training_partitions(n: int, cores: int) -> int:
    """Partitions in which n rows are read by an iterative trainer."""
    return max(1, min(math.ceil(n / ROWS_PER_PARTITION), max(PARTITIONS_PER_CORE * cores, math.ceil(n / MAX_ROWS_PER_PARTITION))))


@contextmanager
def kept_for_training(df: DataFrame):
    """The trainers' columns of df's rows, materialised, in ``training_partitions`` at most; released at the end."""
    cached = df.is_cached
    kept = df if cached else df.select(*[c for c in df.columns if c in (FEATURES, LABEL, WEIGHT, "fold")]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        target = training_partitions(kept.count(), df.sparkSession.sparkContext.defaultParallelism)
        yield kept.coalesce(target) if target < kept.rdd.getNumPartitions() else kept
    finally:
        if not cached:
            kept.unpersist()


def _check_depth(depth: int) -> int:
    if not 0 <= depth <= MAX_TREE_DEPTH:
        raise ValueError(f"maxDepth {depth}: Spark ML trees are at most {MAX_TREE_DEPTH} deep")
    return depth


def assemble(df: DataFrame, columns, out: str = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def from_array(df: DataFrame, arr: str, out: str = FEATURES) -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(arr)))


def logistic_regression(train: DataFrame, C: float = 1.0, penalty: str = "l2",
                        weight_col: str | None = WEIGHT, max_iter: int = 1000,
                        tol: float = 1e-4):
    """L1: weighted logistic regression with the reference's C scale.

    Spark's trainer keeps the rows itself, packed in blocks, so they aren't kept here as well; ``train`` is
    read three times and should be materialised.
    """
    if weight_col and weight_col in train.columns:
        r = train.agg(F.sum(weight_col), F.count(F.lit(1))).first()
        sw, n = r[0], r[1]
    else:
        n = train.count()
        sw, weight_col = float(n), None
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=1.0 / (C * sw),
                            elasticNetParam=1.0 if penalty == "l1" else 0.0,
                            standardization=False, maxIter=max_iter, tol=tol)
    if weight_col:
        lr.setWeightCol(weight_col)
    target = training_partitions(n, train.sparkSession.sparkContext.defaultParallelism)
    return lr.fit(train.coalesce(target) if target < train.rdd.getNumPartitions() else train)


def random_forest(train: DataFrame, n_trees: int = 800, max_depth: int = MAX_TREE_DEPTH,
                  min_instances: int = 1, weight_col: str | None = WEIGHT, seed: int = 123):
    """L2: weighted random forest; a depth above Spark's 30 is an error.

    Few rows take Spark's own trainer, more take ``forest``: the same method with draws of its own.
    """
    from . import forest
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=n_trees,
                                maxDepth=_check_depth(max_depth),
                                minInstancesPerNode=min_instances, seed=seed)
    if weight_col and weight_col in train.columns:
        rf.setWeightCol(weight_col)
    else:
        weight_col = None
    with kept_for_training(train) as rows:
        if rows.count() > SPARK_FOREST_ROWS:
            return forest.fit(rows, n_trees, max_depth, min_instances, LABEL, weight_col, FEATURES, seed)
        return rf.fit(rows)


def boosted_trees(train: DataFrame, n_iter: int = 300, max_depth: int = 10, step: float = 0.1,
                  subsample: float = 0.8, feature_subset: str = "all",
                  weight_col: str | None = WEIGHT, seed: int = 123):
    """L3: gradient-boosted trees with positive-class row weights."""
    gbt = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=n_iter,
                        maxDepth=_check_depth(max_depth), stepSize=step,
                        subsamplingRate=subsample, featureSubsetStrategy=feature_subset, seed=seed)
    if weight_col and weight_col in train.columns:
        gbt.setWeightCol(weight_col)
    with kept_for_training(train) as rows:
        return gbt.fit(rows)


def neural_network(train: DataFrame, n_features: int, hidden=HIDDEN_LAYERS, max_iter: int = 100,
                   block_size: int = 256, seed: int = 123):
    """L4: feed-forward network (no row weights in Spark: use rebalanced rows).

    Rows that one partition takes are trained by Spark's own passes, more by ``sigmoid_network``:
    the same objective, start and descent, sums in another order.
    """
    from . import sigmoid_network  # needs this module
    mlp = MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=LABEL,
                                         layers=[n_features, *hidden, 2], maxIter=max_iter,
                                         blockSize=block_size, seed=seed)
    with kept_for_training(train) as rows:
        return sigmoid_network.fit(mlp, rows) if rows.count() > ROWS_PER_PARTITION else mlp.fit(rows)


def fold_column(df: DataFrame, k: int = 5, label: str = LABEL, key: str = "row_id",
                seed: int = 123, out: str = "fold") -> DataFrame:
    """Stratified fold ids: rank in hash order within each class, modulo k."""
    return (hash_rank(df, [label], key, seed)
            .withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank"))


def grid_search(train: DataFrame, estimator, grid, k: int = 5, parallelism: int = 4,
                key: str = "row_id", seed: int = 123):
    """Stratified k-fold grid search scored by F1 of the positive class."""
    # every fold filters this table: keep it rather than re-ranking per fold
    folded = fold_column(train, k, key=key, seed=seed)
    ev = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction",
                                           metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=ev,
                        foldCol="fold", numFolds=k, parallelism=parallelism, seed=seed)
    with kept_for_training(folded) as rows:
        return cv.fit(rows)


def best_parameters(grid, cv) -> dict:
    """Name -> value of the grid point with the best mean score (the first of equals)."""
    best = max(range(len(grid)), key=lambda i: cv.avgMetrics[i])
    return {p.name: v for p, v in grid[best].items()}


def rf_grid(rf: RandomForestClassifier, trees=RF_TREES, depths=RF_DEPTHS, min_instances=RF_MIN_INSTANCES):
    """Depths 40 and unlimited have no Spark twin (30 is its limit), nor has a least split size."""
    b = ParamGridBuilder()
    b.addGrid(rf.numTrees, list(trees))
    b.addGrid(rf.maxDepth, [_check_depth(d) for d in depths])
    b.addGrid(rf.minInstancesPerNode, list(min_instances))
    return b.build()


def gbt_grid(gbt: GBTClassifier, depths=GBT_DEPTHS, steps=GBT_STEPS, rounds=GBT_ROUNDS,
             subsamples=GBT_SUBSAMPLES, columns=GBT_COLUMNS):
    b = ParamGridBuilder()
    b.addGrid(gbt.maxDepth, [_check_depth(d) for d in depths])
    b.addGrid(gbt.stepSize, list(steps))
    b.addGrid(gbt.maxIter, list(rounds))
    b.addGrid(gbt.subsamplingRate, list(subsamples))
    b.addGrid(gbt.featureSubsetStrategy, list(columns))
    return b.build()


def lr_grid(lr: LogisticRegression, sum_w: float, Cs=LR_CS, penalties=LR_PENALTIES):
    b = ParamGridBuilder()
    b.addGrid(lr.regParam, [1.0 / (c * sum_w) for c in Cs])
    b.addGrid(lr.elasticNetParam, [1.0 if p == "l1" else 0.0 for p in penalties])
    return b.build()


class LinearScorer:
    """A linear classifier of given coefficients, with the interface of a fitted model."""

    def __init__(self, coefficients, intercept: float = 0.0):
        self.coefficients, self.intercept = Vectors.dense([float(c) for c in coefficients]), float(intercept)

    def probability(self, vec) -> "F.Column":
        """The probability of class 1 of an array column."""
        terms = F.zip_with(vec, F.array(*[F.lit(c) for c in self.coefficients.toArray().tolist()]), lambda x, c: x * c)
        return F.lit(1.0) / (F.exp(-F.aggregate(terms, F.lit(self.intercept), lambda a, b: a + b)) + 1)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_linear_p", self.probability(vector_to_array(FEATURES))).withColumns({"probability": array_to_vector(F.array(F.lit(1.0) - F.col("_linear_p"), F.col("_linear_p"))),
                                                   "prediction": (F.col("_linear_p") > 0.5).cast("double")}).drop("_linear_p")


def score(model, df: DataFrame, name: str, key: str = "row_id") -> DataFrame:
    """L11 input: the positive-class probability as a long score row."""
    out = model.transform(df)
    return out.select(F.col(key).alias("row_id"), F.col(LABEL).cast("int").alias("label"),
                      F.lit(name).alias("model"),
                      vector_to_array("probability")[1].alias("proba"))


def linear_scores(models: dict, df: DataFrame, key: str = "row_id", vec: str = "features_arr") -> DataFrame:
    """The long score rows of several linear scorers, in one pass over df."""
    each = F.array(*[F.struct(F.lit(name).alias("model"), m.probability(F.col(vec)).alias("proba")) for name, m in models.items()])
    return df.select(F.col(key).alias("row_id"), F.col(LABEL).cast("int").alias("label"), F.inline(each))
