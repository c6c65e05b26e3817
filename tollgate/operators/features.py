"""Standard scaling and principal components, fitted on the train part only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature: as many numbers as there are features."""

    features: tuple
    mean: tuple
    std: tuple

    def expression(self, name: str) -> Column:
        i = self.features.index(name)
        return (F.col(name) - F.lit(self.mean[i])) / F.lit(self.std[i] or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expression(c) for c in self.features})


def scaler_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: mean, population deviation and the scale used (1 for a constant column)."""
    both = [c for f in features for c in (F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std"))]
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"), F.col(f"{f}__std").alias("std"))
        for f in features
    ])
    stats = df.agg(*both).select(F.inline(rows))
    return stats.withColumn("scale", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    found = {r["feature"]: r for r in scaler_stats(df, features).collect()}
    return Scaler(tuple(features), tuple(found[f]["mean"] for f in features), tuple(found[f]["std"] for f in features))


def use_components(feature_count: int, enabled: bool, max_features: int = 50) -> bool:
    return enabled and feature_count > max_features


@dataclass(frozen=True)
class Components:
    """A fitted PCA with the signs fixed: each component's largest loading is positive."""

    model: PCAModel
    sign: tuple

    @property
    def loadings(self) -> np.ndarray:
        return self.model.pc.toArray() * np.array(self.sign)

    @property
    def explained(self) -> list:
        return [float(x) for x in self.model.explainedVariance]

    def transform(self, df: DataFrame, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
        """Add PC1..PCk. The input must be centred, as it is after scaling."""
        projected = self.model.transform(df.withColumn("__v", array_to_vector(features)))
        scores = vector_to_array("__pc")
        return projected.withColumn("__scores", scores).select(
            *keep, *[(F.col("__scores")[i] * F.lit(float(s))).alias(f"PC{i + 1}") for i, s in enumerate(self.sign)])


def fit_components(df: DataFrame, features: str, count: int, n_components: int = 30) -> Components:
    """Fit on an array column. The covariance is summed on the executors; one features x features matrix comes back."""
    k = min(n_components, count)
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(df.select(array_to_vector(features).alias("__v")))
    loadings = model.pc.toArray()
    largest = np.abs(loadings).argmax(axis=0)
    sign = tuple(float(np.sign(loadings[row, column]) or 1.0) for column, row in enumerate(largest))
    return Components(model, sign)


def scale_array(df: DataFrame, features: str, count: int) -> tuple[DataFrame, Scaler]:
    """Scale an array column. Returns the table with the scaled array and the fitted scaler."""
    names = [f"x{i}" for i in range(count)]
    columns = df.select("*", *[F.col(features)[i].alias(n) for i, n in enumerate(names)])
    scaler = fit_scaler(columns, names)
    scaled = F.array(*[scaler.expression(n) for n in names])
    return columns.withColumn(features, scaled).drop(*names), scaler
