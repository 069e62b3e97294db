"""Scaling, forests, calibration and evaluation."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import read_text, write_text


@dataclass
class Scaler:
    """Centre and scale of each column; a scale of None or 0 gives 0."""

    kind: str
    centre: dict[str, float | None]
    scale: dict[str, float | None]

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        made = {}
        for c, m in self.centre.items():
            s = self.scale[c]
            value = F.when(F.col(c).isNotNull(), F.lit(0.0)) if not s or m is None else (F.col(c) - F.lit(m)) / F.lit(s)
            made[c + suffix] = value
        return df.withColumns(made)

    def save(self, path: str) -> None:
        write_text(path, json.dumps(self.__dict__))

    @staticmethod
    def load(path: str) -> Scaler:
        return Scaler(**json.loads(read_text(path)))


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "zscore") -> Scaler:
    """zscore: mean and sample deviation; minmax: least and range; robust: median
    and interquartile range, or the deviation where that is 0. One aggregate."""
    stats = {"zscore": lambda c: (F.avg(c), F.stddev_samp(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)), "robust": lambda c: (F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25)))}[kind]
    parts = []
    for c in columns:
        m, s = stats(c)
        parts += [m.cast("double").alias(f"m_{c}"), s.cast("double").alias(f"s_{c}")] + ([F.stddev_samp(c).alias(f"d_{c}")] if kind == "robust" else [])
    row = df.agg(*parts).first().asDict()
    scale = {c: row[f"s_{c}"] or (row.get(f"d_{c}") if kind == "robust" else None) for c in columns}
    return Scaler(kind, {c: row[f"m_{c}"] for c in columns}, scale)


@dataclass(frozen=True)
class Forest:
    trees: int = 100
    depth: int = 16
    bins: int = 128
    rows: float = 0.8
    features: str = "0.9"
    seed: int = 42


REGIME_FOREST = Forest()
BLENDER_FOREST = Forest(trees=200, depth=22, rows=0.6, features="0.6")
#: Fewest rows for a model of its own.
MINIMUM = {"direction": 1000, "regime_signal": 5000, "regime_direction": 3000, "calibrator": 100}


@dataclass
class Classifier:
    """A forest over named columns: missing ones are 0, others are ignored."""

    model: RandomForestClassificationModel
    columns: list[str]
    labels: list[str]
    calibrators: dict[int, tuple[list[float], list[float]]] = field(default_factory=dict)
    alpha: float = 1.0

    def probabilities(self, df: DataFrame, output: str = "probs") -> DataFrame:
        have = set(df.columns)
        inputs = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in self.columns))
        scored = self.model.transform(df.withColumn("__features", array_to_vector(inputs)))
        probs = vector_to_array("probability")
        if self.calibrators:
            probs = F.array(*(interpolate(probs[k], *self.calibrators[k]) if k in self.calibrators else probs[k] for k in range(len(self.labels))))
        drop = ["__features", "rawPrediction", "probability", "prediction"]
        return scored.withColumn(output, sharpen(probs, self.alpha)).drop(*drop)

    def predict(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        scored = self.probabilities(df, "__probs")
        at = F.array_position("__probs", F.array_max("__probs")).cast("int") - 1
        return scored.withColumn(output, F.array(*(F.lit(x) for x in self.labels))[at]).drop("__probs")

    def importances(self) -> dict[str, float]:
        return dict(zip(self.columns, self.model.featureImportances.toArray().tolist(), strict=True))

    def save(self, path: str, sidecar: str) -> None:
        self.model.write().overwrite().save(path)
        write_text(sidecar, json.dumps({"columns": self.columns, "labels": self.labels, "calibrators": self.calibrators, "alpha": self.alpha}))

    @staticmethod
    def load(path: str, sidecar: str) -> Classifier:
        kept = json.loads(read_text(sidecar))
        return Classifier(RandomForestClassificationModel.load(path), kept["columns"], kept["labels"], {int(k): tuple(v) for k, v in kept["calibrators"].items()}, kept["alpha"])


def fit_forest(df: DataFrame, columns: list[str], label: str, forest: Forest = REGIME_FOREST, labels: list[str] | None = None) -> Classifier:
    """Classes are the labels in sorted order, as text. Null labels take no part."""
    rows = df.where(F.col(label).isNotNull())
    found = labels or sorted(str(r[0]) for r in rows.select(F.col(label).cast("string")).distinct().collect())
    code = F.array_position(F.array(*(F.lit(x) for x in found)), F.col(label).cast("string")).cast("double") - 1
    inputs = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    data = rows.select(array_to_vector(inputs).alias("__features"), code.alias("__label"))
    model = RandomForestClassifier(featuresCol="__features", labelCol="__label", numTrees=forest.trees, maxDepth=forest.depth, maxBins=forest.bins, subsamplingRate=forest.rows, featureSubsetStrategy=forest.features, seed=forest.seed).fit(data)
    return Classifier(model, list(columns), found)


def interpolate(p: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through (xs, ys), constant outside."""
    out = F.when(p <= xs[0], ys[0])
    for (a, b), (u, v) in zip(zip(xs[:-1], xs[1:], strict=True), zip(ys[:-1], ys[1:], strict=True), strict=True):
        out = out.when(p <= b, F.lit(u) + (p - a) * ((v - u) / (b - a) if b > a else 0.0))
    return out.otherwise(ys[-1])


def fit_isotonic(df: DataFrame, prob: str, hit: str) -> tuple[list[float], list[float]]:
    model = IsotonicRegression(featuresCol=prob, labelCol=hit).fit(df.select(F.col(prob).cast("double").alias(prob), F.col(hit).cast("double").alias(hit)))
    return model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()


def fit_platt(df: DataFrame, prob: str, hit: str, points: int = 101) -> tuple[list[float], list[float]]:
    """Logistic regression on the probability, tabled."""
    data = VectorAssembler(inputCols=[prob], outputCol="__x").transform(df.select(F.col(prob).cast("double").alias(prob), F.col(hit).cast("double").alias("__y")))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / max(1, data.count())).fit(data)
    xs = [k / (points - 1) for k in range(points)]
    return xs, [1 / (1 + math.exp(-(model.coefficients[0] * x + model.intercept))) for x in xs]


def calibrate(classifier: Classifier, df: DataFrame, label: str, method: str = "isotonic", alpha: float = 2.0) -> Classifier:
    """A copy with a calibrator for each class of enough positives, and sharpening."""
    scored = classifier.probabilities(df).select("probs", F.col(label).cast("string").alias("__label")).persist()
    fit, made = {"isotonic": fit_isotonic, "platt": fit_platt}[method], {}
    for k, name in enumerate(classifier.labels):
        one = scored.select(F.col("probs")[k].alias("p"), (F.col("__label") == name).cast("double").alias("hit"))
        if one.where("hit = 1").count() >= MINIMUM["calibrator"]:
            made[k] = fit(one, "p", "hit")
    scored.unpersist()
    return Classifier(classifier.model, classifier.columns, classifier.labels, made, min(max(alpha, 1.0), 3.0))


def sharpen(probs: Column, alpha: float = 1.0, floor: float = 1e-6) -> Column:
    """p ** alpha over its sum, after bounding p away from 0 and 1."""
    raised = F.transform(probs, lambda p: F.pow(F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor)), F.lit(alpha)))
    return F.transform(raised, lambda p: p / F.aggregate(raised, F.lit(0.0), lambda a, x: a + x))


def regime_models(df: DataFrame, columns: list[str], label: str, least: int, forest: Forest = BLENDER_FOREST, labels: list[str] | None = None) -> dict[str, Classifier]:
    """A model for each regime with rows enough."""
    counts = {r[0]: r[1] for r in df.groupBy("regime").count().collect()}
    return {g: fit_forest(df.where(F.col("regime") == g), columns, label, forest, labels) for g, n in sorted(counts.items()) if g is not None and n >= least}


def by_regime(df: DataFrame, model: Classifier, own: dict[str, Classifier], output: str) -> DataFrame:
    """Adds the probabilities of ``model``'s labels, by the row's regime's own model where it has one."""
    df = model.probabilities(df, output)
    chosen = F.col(output)
    for regime, other in own.items():
        df = other.probabilities(df, f"__{regime}")
        probs = F.array(*(F.col(f"__{regime}")[other.labels.index(x)] if x in other.labels else F.lit(0.0) for x in model.labels))
        chosen = F.when(F.col("regime") == regime, probs).otherwise(chosen)
    return df.withColumn(output, chosen).drop(*(f"__{r}" for r in own))


def pruned_columns(importances: dict[str, float], percentile: float = 20.0) -> list[str]:
    """Columns strictly above the given percentile of importance."""
    values = sorted(importances.values())
    if not values:
        return []
    at = (len(values) - 1) * percentile / 100
    low, share = int(at), at - int(at)
    edge = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * share
    return [c for c, v in importances.items() if v > edge]


def train_pipeline(df: DataFrame, columns: list[str], label: str, forest: Forest = BLENDER_FOREST, prune: float = 20.0, share: float = 0.8) -> tuple[Classifier, DataFrame]:
    """Fit on the first ``share`` of each series, prune, refit with the same
    forest; and the confusion counts of the rest."""
    from .splits import chronological

    parts = chronological(df, share)
    train, rest = parts.where("part = 'train'"), parts.where("part = 'validation'")
    first = fit_forest(train, columns, label, forest)
    kept = pruned_columns(first.importances(), prune) or columns
    model = fit_forest(train, kept, label, forest, first.labels)
    return model, confusion(model.predict(rest), label, "predicted", model.labels)


def confusion(df: DataFrame, label: str, predicted: str, labels: list[str]) -> DataFrame:
    """A row for each label and a column for each prediction, absent ones 0."""
    counts = df.groupBy(F.col(label).cast("string").alias("label")).pivot(predicted, labels).count()
    every = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return every.join(counts, "label", "left").fillna(0)


def accuracy(df: DataFrame, label: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg((F.col(label).cast("string") == F.col(predicted).cast("string")).cast("double")).alias("accuracy"))


def probability_histogram(df: DataFrame, prob: str, edges: tuple[float, ...] = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.01)) -> DataFrame:
    """Counts in [edge, next edge); values outside are left out."""
    p = F.col(prob)
    number = F.coalesce(*(F.when((p >= a) & (p < b), F.lit(k)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))))
    return df.withColumn("bin", number).where("bin is not null").groupBy("bin").count()


def importances_frame(spark: SparkSession, classifier: Classifier) -> DataFrame:
    return spark.createDataFrame(sorted(classifier.importances().items(), key=lambda kv: -kv[1]), "feature string, importance double")


def preferred_model(spark: SparkSession, folder: str, name: str) -> str:
    """The calibrated variant's path if it is there, else the plain one's."""
    conf = spark._jsc.hadoopConfiguration()
    for path in (f"{folder}/{name}_calibrated", f"{folder}/{name}"):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(f"{folder}/{name}")
