"""L8 two-stage weighted blend and L9 stage counts.

Stage 1 (recall models) takes the row-wise maximum, stage 2 (precision models)
the row-wise mean; the blend is 0.70 * stage1 + 0.30 * stage2, or the one
stage that is present. Fewer than two models: no ensemble.
"""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, MLReader, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import ForestModel
from .network import NetworkModel

# Model roles and stage weights.
RECALL_MODELS = ["lr", "rf"]
PRECISION_MODELS = ["nn", "gbt"]
RECALL_WEIGHT = 0.70
PRECISION_WEIGHT = 0.30
STAGE1_CUT = 0.5


def _combine(s1: "F.Column", s2: "F.Column") -> "F.Column":
    return (F.when(s1.isNotNull() & s2.isNotNull(),
                   F.lit(RECALL_WEIGHT) * s1 + F.lit(PRECISION_WEIGHT) * s2)
            .when(s1.isNotNull(), s1).otherwise(s2))


def blend_wide(df: DataFrame, proba_cols: dict, out: str = "proba_ensemble") -> DataFrame:
    """Blend per-model probability columns of a wide table (a projection).

    ``proba_cols`` maps model name -> column name.
    """
    present = {m: c for m, c in proba_cols.items() if c in df.columns}
    if len(present) < 2:
        raise ValueError("need at least two base models for the ensemble")
    rec = [F.col(present[m]) for m in RECALL_MODELS if m in present]
    pre = [F.col(present[m]) for m in PRECISION_MODELS if m in present]
    s1 = (rec[0] if len(rec) == 1 else F.greatest(*rec)) if rec else F.lit(None).cast("double")
    s2 = (sum(pre[1:], pre[0]) / F.lit(float(len(pre)))) if pre else F.lit(None).cast("double")
    return df.withColumn(out, _combine(s1, s2))


def stages_long(scores: DataFrame, key: str = "row_id", label: str = "label") -> DataFrame:
    """Stage 1 and stage 2 probabilities from a long (row, model, proba) table."""
    m, p = F.col("model"), F.col("proba")
    return (scores.groupBy(key, label)
            .agg(F.max(F.when(m.isin(RECALL_MODELS), p)).alias("stage1"),
                 F.avg(F.when(m.isin(PRECISION_MODELS), p)).alias("stage2")))


def blend_long(scores: DataFrame, key: str = "row_id", label: str = "label",
               name: str = "ensemble", models=None) -> DataFrame:
    """L8 on a long score table -> rows (key, label, model=name, proba)."""
    if models is None:  # model names only (a handful of rows)
        models = [r[0] for r in scores.select("model").distinct().collect()]
    if len(models) < 2:
        raise ValueError("need at least two base models for the ensemble")
    st = stages_long(scores, key, label)
    return st.select(key, label, F.lit(name).alias("model"),
                     _combine(F.col("stage1"), F.col("stage2")).alias("proba"))


def stage_counts(scores: DataFrame, thresholds: DataFrame, key: str = "row_id",
                 label: str = "label") -> DataFrame:
    """Rows at or above each model's own threshold, and the stage-1 total at 0.5."""
    from .evaluate import threshold_map
    tm = threshold_map(thresholds)                 # one scalar per model
    lookup = F.create_map(*[x for m, t in tm.items() for x in (F.lit(m), F.lit(t))])
    per_model = (scores.withColumn("threshold", lookup[F.col("model")])
                 .where(F.col("threshold").isNotNull())
                 .groupBy("model", "threshold")
                 .agg(F.count_if(F.col("proba") >= F.col("threshold")).alias("n_flagged")))
    stage1 = (stages_long(scores, key, label)
              .agg(F.count_if(F.col("stage1") >= STAGE1_CUT).alias("n_flagged"))
              .select(F.lit("stage1").alias("model"), F.lit(STAGE1_CUT).alias("threshold"),
                      "n_flagged"))
    return per_model.unionByName(stage1)


class EnsembleModel(Model):
    """L8 as a Spark ML model over fitted base models (by name: lr, rf, nn, gbt; two at least).

    ``transform`` adds ``probability`` (of the blend) and ``prediction`` (at the
    threshold or above); it can be saved and loaded like any other model.
    """

    def __init__(self, models: dict, threshold: float = STAGE1_CUT):
        super().__init__()
        unknown = set(models) - {*RECALL_MODELS, *PRECISION_MODELS}
        if unknown or len(models) < 2:
            raise ValueError(f"an ensemble needs two or more of {RECALL_MODELS + PRECISION_MODELS}, not {sorted(models)}")
        self.models, self.threshold = dict(models), float(threshold)

    def _transform(self, df: DataFrame) -> DataFrame:
        added, own = ["rawPrediction", "probability", "prediction"], {}
        for name, model in self.models.items():
            own[name] = f"_p_{name}"
            df = model.transform(df.drop(*added)).withColumn(own[name], vector_to_array("probability")[1])
        df = blend_wide(df.drop(*added), own, "_blend")
        return df.withColumns({"probability": array_to_vector(F.array(F.lit(1.0) - F.col("_blend"), F.col("_blend"))),
                               "prediction": (F.col("_blend") >= F.lit(self.threshold)).cast("double")}).drop("_blend", *own.values())

    def write(self) -> "EnsembleWriter":
        return EnsembleWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> "EnsembleReader":
        return EnsembleReader()

    @classmethod
    def load(cls, path: str) -> "EnsembleModel":
        return cls.read().load(path)


class EnsembleWriter(MLWriter):
    """Writes each base model to ``models/<name>`` and the rest to ``ensemble``."""

    def __init__(self, model: EnsembleModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        for name, m in self.model.models.items():
            m.write().save(f"{path}/models/{name}")
        kinds = {name: "network" if isinstance(m, NetworkModel) else "forest" if isinstance(m, ForestModel) else "spark" for name, m in self.model.models.items()}
        about = json.dumps({"models": kinds, "threshold": self.model.threshold})
        self.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/ensemble")


class EnsembleReader(MLReader):
    def load(self, path: str) -> EnsembleModel:
        about = json.loads(self.sparkSession.read.text(f"{path}/ensemble").first()[0])
        models = {}
        for name, kind in about["models"].items():
            at = f"{path}/models/{name}"
            own = {"network": NetworkModel, "forest": ForestModel}.get(kind)
            models[name] = own.load(at) if own else DefaultParamsReader.loadParamsInstance(at, self.sparkSession)
        return EnsembleModel(models, about["threshold"])
