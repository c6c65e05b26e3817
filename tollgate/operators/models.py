"""Two models: the random forest, and a closed-form Gaussian naive Bayes that SQL can check row by row.

The closed-form model is an addition. It makes every score comparable with an independent SQL query, which the forest's
binned splits do not allow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log, sqrt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import key_hash
from tollgate.operators.features import Scaler

SMALLEST_VARIANCE = 1e-9
#: With more features a score is kept out of Spark's fused code, where it makes a method too long for the JVM to compile: it
#: starts from a sum over an array, which is not fused. The value is the same.
WIDE = 16


@dataclass(frozen=True)
class GaussianModel:
    """Class priors with mean and variance per feature and class; optionally the scaler it was trained behind."""

    features: tuple
    prior: tuple  # rows of class 0 and of class 1
    mean: tuple  # per feature: (class 0, class 1)
    variance: tuple
    scaler: Scaler | None = None

    def log_odds(self) -> Column:
        z = F.lit(log(self.prior[1] / self.prior[0]))
        if len(self.features) > WIDE:
            z = F.reduce(F.array(z), F.lit(0.0), lambda a, x: a + x)
        for i, name in enumerate(self.features):
            x = self.scaler.expression(name) if self.scaler else F.col(name)
            (m0, m1), (v0, v1) = self.mean[i], self.variance[i]
            z = z - F.lit(0.5 * log(v1 / v0)) - (x - m1) * (x - m1) / (2 * v1) + (x - m0) * (x - m0) / (2 * v0)
        return z

    def table(self, spark: SparkSession) -> DataFrame:
        """The coefficients as a table, one row per feature: the exported form of the model."""
        rows = [
            (name, *map(float, self.prior), *map(float, self.mean[i]), *map(float, self.variance[i]),
             self.scaler.mean[i] if self.scaler else None, self.scaler.std[i] if self.scaler else None)
            for i, name in enumerate(self.features)
        ]
        return spark.createDataFrame(
            rows, "feature string, n0 double, n1 double, mean0 double, mean1 double, var0 double, var1 double,"
                  " scaler_mean double, scaler_std double")

    @staticmethod
    def from_table(coefficients: DataFrame, features: Sequence[str]) -> GaussianModel:
        found = {r["feature"]: r for r in coefficients.collect()}
        rows = [found[f] for f in features]
        scaler = None
        if rows[0]["scaler_mean"] is not None:
            scaler = Scaler(tuple(features), tuple(r["scaler_mean"] for r in rows), tuple(r["scaler_std"] for r in rows))
        return GaussianModel(
            tuple(features), (rows[0]["n0"], rows[0]["n1"]), tuple((r["mean0"], r["mean1"]) for r in rows),
            tuple((r["var0"], r["var1"]) for r in rows), scaler)


def fit_gaussian(df: DataFrame, features: Sequence[str], label: str = "label", scaled: bool = True) -> GaussianModel:
    """Scaler and model from one aggregate: rows, mean and variance per class and feature.

    The scaler's moments follow from those of the classes, and the classes' scaled moments from both, so the table is
    read once. Two rows of numbers reach the driver.
    """
    moments = [
        a for f in features for a in (
            F.count(f).alias(f"{f}__n"), F.avg(f).alias(f"{f}__mean"), F.var_pop(f).alias(f"{f}__var"))
    ]
    rows = df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *moments).collect()
    found = {r[label]: r for r in rows}
    if set(found) != {0, 1}:
        raise ValueError("both classes are needed to fit")
    pair = lambda f, part: tuple(found[c][f"{f}__{part}"] for c in (0, 1))
    mean, variance = [pair(f, "mean") for f in features], [pair(f, "var") for f in features]
    scaler = None
    if scaled:
        pooled = [_pool(pair(f, "n"), m, v) for f, m, v in zip(features, mean, variance)]
        scaler = Scaler(tuple(features), tuple(m for m, _ in pooled), tuple(s for _, s in pooled))
        mean = [tuple((m - c) / (s or 1.0) for m in pair_) for pair_, (c, s) in zip(mean, pooled)]
        variance = [tuple(v / (s or 1.0) ** 2 for v in pair_) for pair_, (_, s) in zip(variance, pooled)]
    floor = [tuple(max(v, SMALLEST_VARIANCE) for v in pair_) for pair_ in variance]
    return GaussianModel(tuple(features), (found[0]["n"], found[1]["n"]), tuple(mean), tuple(floor), scaler)


def _pool(n: tuple, mean: tuple, variance: tuple) -> tuple[float, float]:
    """Mean and population deviation of two groups together."""
    total = sum(n)
    centre = sum(a * b for a, b in zip(n, mean)) / total
    spread = sum(a * (v + (m - centre) ** 2) for a, m, v in zip(n, mean, variance)) / total
    return centre, sqrt(spread)


def fit_forest(df: DataFrame, key: str, features: Sequence[str], label: str = "label", n_estimators: int = 100,
               max_depth: int = 10, seed: int = P.SEED, partitions: int = P.TrainingParams.forest_partitions,
               bootstrap: bool = True) -> PipelineModel:
    """Random forest with gini splits and the square root of the features per node.

    The same seed gives another forest when rows arrive in another order, so the rows are put into key order first,
    with a partition count that is part of the training parameters and depends on neither the input nor the cluster.
    """
    ordered = df.select(key, *features, label).repartition(partitions, key_hash(key, seed)).sortWithinPartitions(key)
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="__features", numTrees=n_estimators, maxDepth=max_depth, impurity="gini",
        featureSubsetStrategy="sqrt", bootstrap=bootstrap, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__features"), forest]).fit(ordered)


def forest_scores(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keep columns, prediction (1 iff P(class 1) > 0.5) and P(class 1)."""
    p = vector_to_array("probability")[1]
    return model.transform(df).select(*keep, p.alias("probability")).select(
        *keep, (F.col("probability") > 0.5).cast("int").alias("prediction"), "probability")
