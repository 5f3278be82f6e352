"""Churn classifiers: training, scoring, evaluation and importances."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.boosting import BoostedTrees, SecondOrderParams, fit_trees
from ebbtide.operators.metrics import classification_metrics
from ebbtide.operators.prep import Encoder, FeatureSpec, fit_features
from ebbtide.session import release, stage, stage_root

TASK_ROWS = 1 << 14  # training rows worth a task of their own: the learners pass over them hundreds of times


@dataclass(frozen=True)
class LogisticParams:
    """Defaults of the linear model. ``c`` is the inverse penalty on the summed loss."""

    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-6


@dataclass(frozen=True)
class BoostedParams:
    """Defaults of the boosted model, except ``bins``, which is ours."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    min_gain: float = 0.0
    seed: int = 42
    bins: int = 64


@dataclass(frozen=True)
class Prepared:
    """Fitted preparation and the training rows as a stage table (key, label, features)."""

    spec: FeatureSpec
    pipeline: Encoder
    train: DataFrame
    label: str

    @cached_property
    def names(self) -> list[str]:
        """Feature names on the driver, in vector order; ``spec.names`` leaves them in the cluster."""
        return [r["feature"] for r in self.spec.names().orderBy("slot").collect()]


@dataclass(frozen=True)
class Classifier:
    """A fitted preparation and the learner fitted to its vectors."""

    stages: list

    def transform(self, df: DataFrame) -> DataFrame:
        for part in self.stages:
            df = part.transform(df)
        return df


def prepare(train: DataFrame, key: str, label: str, exclude=()) -> Prepared:
    """Fit the preparation once and write the encoded training rows, which both learners then iterate over."""
    rows = train.where(F.col(label).isNotNull())
    spec = fit_features(rows, exclude=(key, label, *exclude))
    pipeline = spec.pipeline(rows)
    return Prepared(spec, pipeline, _spread(stage(pipeline.transform(rows).select(key, label, "features"), "train")), label)


def _spread(train: DataFrame) -> DataFrame:
    """The stage table in files for every core, if its rows are many: shuffles are cut by bytes, and encoded rows are few
    bytes for much work. Four files a core, as Spark's reader packs several into a task."""
    parts, cores = -(-train.count() // TASK_ROWS), train.sparkSession.sparkContext.defaultParallelism
    if train.rdd.getNumPartitions() >= min(parts, cores):
        return train
    spread = stage(train.repartition(min(parts, 4 * cores)), "train")
    release(train)
    return spread


def train_logistic(prepared: Prepared, params: LogisticParams = LogisticParams()) -> Classifier:
    """L2 logistic regression. The penalty is 1/(c * rows) because Spark averages the loss over rows."""
    learner = LogisticRegression(
        labelCol=prepared.label, regParam=1.0 / (params.c * prepared.train.count()), elasticNetParam=0.0,
        standardization=False, maxIter=params.max_iter, tol=params.tol,
    )
    return Classifier([prepared.pipeline, learner.fit(prepared.train)])


def train_boosted(prepared: Prepared, params: BoostedParams = BoostedParams()) -> Classifier:
    """Gradient-boosted trees with logistic loss."""
    stage_root(prepared.train.sparkSession)  # names the checkpoint folder that cuts the boosting lineage
    learner = GBTClassifier(
        labelCol=prepared.label, maxIter=params.trees, maxDepth=params.depth, stepSize=params.rate,
        subsamplingRate=params.row_share, featureSubsetStrategy=str(params.column_share),
        minInfoGain=params.min_gain, seed=params.seed, maxBins=params.bins,
    )
    return Classifier([prepared.pipeline, learner.fit(prepared.train)])


def train_second_order(prepared: Prepared, key: str, params: SecondOrderParams = SecondOrderParams()) -> Classifier:
    """Boosted trees by gradient and curvature, with penalised leaf weights and a column sample per tree."""
    learner = fit_trees(prepared.train, key, prepared.label, prepared.spec, params)
    return Classifier([prepared.pipeline, learner])


LEARNERS = {"logistic": LogisticRegressionModel, "boosted": GBTClassificationModel, "second_order": BoostedTrees}


def save_model(model: Classifier, path: str) -> None:
    """The learner, the slot table and the numbers per column, each in a folder of its own below ``path``."""
    encoder, learner = model.stages
    kind = next(k for k, c in LEARNERS.items() if isinstance(learner, c))
    if kind == "second_order":
        learner.save(f"{path}/learner")
    else:
        learner.write().overwrite().save(f"{path}/learner")
    spec = encoder.spec
    spec.slots.write.mode("overwrite").parquet(f"{path}/slots")
    numbers = {f.name: getattr(spec, f.name) for f in fields(spec) if f.name not in ("slots", "path")}
    spark = spec.slots.sparkSession
    spark.createDataFrame([(json.dumps({"kind": kind, **numbers}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def load_model(path: str) -> Classifier:
    spark = SparkSession.active()
    numbers = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    learner = LEARNERS[numbers.pop("kind")].load(f"{path}/learner")
    numbers["literals"] = {c: [tuple(x) for x in found] for c, found in numbers["literals"].items()}
    numbers["scale"] = {c: tuple(x) for c, x in numbers["scale"].items()}
    spec = FeatureSpec(**numbers, slots=spark.read.parquet(f"{path}/slots"), path=f"{path}/slots")
    return Classifier([Encoder(spec), learner])


def score(model: Classifier, df: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """(key, label, model, p): probability of churn per row."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(df).select(key, label, F.lit(name).alias("model"), p.alias("p"))


def attach_scores(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Scores joined back by key; a row without a score keeps NULL."""
    return df.join(scores, key, "left")


def evaluate(scores: DataFrame, label: str) -> DataFrame:
    """Metrics per model of a (label, model, p) table."""
    return classification_metrics(scores, label, "p", by="model")


def _importance_table(spark, names: list[str] | DataFrame, values) -> DataFrame:
    """(feature, importance). The values are as many as the model's own vectors; names in a (slot, feature) table join
    them there."""
    listed = isinstance(names, list)
    size = len(names) if listed else names.count()
    if size != len(values):
        raise ValueError(f"{size} feature names for {len(values)} importances")
    if listed:
        rows = [(n, float(v)) for n, v in zip(names, values)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    sized = spark.createDataFrame(list(enumerate(map(float, values))), "slot long, importance double")
    return names.join(sized, "slot").select("feature", "importance").orderBy(F.desc("importance"), "feature")


def feature_importance(model: Classifier, prepared: Prepared) -> DataFrame:
    """(feature, importance), most important first: absolute coefficients, or gains that sum to one."""
    spark, learner = prepared.train.sparkSession, model.stages[-1]
    if hasattr(learner, "coefficients"):
        return _importance_table(spark, prepared.spec.names(), [abs(c) for c in learner.coefficients.toArray()])
    if hasattr(learner, "featureImportances"):
        return _importance_table(spark, prepared.spec.names(), learner.featureImportances.toArray())
    raise TypeError(f"no importances for {type(learner).__name__}")
