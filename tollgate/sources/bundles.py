"""A trained model with everything it scores with, stored as one folder: scaler, components and forest, or coefficients.

Versions of a registry table name their folder in ``bundle``, so scoring starts from a stage: stage to version, version
to folder, folder to predictions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCAModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators.features import Components, Scaler
from tollgate.operators.models import GaussianModel, forest_scores
from tollgate.operators.registry import stage_holders
from tollgate.operators.scoring import score

META = "kind string, features array<string>, mean array<double>, std array<double>, sign array<double>"


@dataclass(frozen=True)
class Bundle:
    """A closed-form model (which holds its scaler), or a forest with its scaler and, if it has them, its components."""

    features: tuple
    model: GaussianModel | PipelineModel
    scaler: Scaler | None = None
    components: Components | None = None

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns, prediction and probability of class 1 for rows with raw features."""
        if isinstance(self.model, GaussianModel):
            return score(self.model, df, keep)
        kept = {c: f"__kept_{c}" for c in keep}  # a kept column may be a feature, which is scaled below
        rows = df.withColumns({new: F.col(old) for old, new in kept.items()})
        rows = self.scaler.transform(rows)
        if self.components:
            rows = self.components.transform(rows.withColumn("__x", F.array(*self.features)), "__x", list(kept.values()))
        scored = forest_scores(self.model, rows, list(kept.values()))
        return scored.select(*[F.col(new).alias(old) for old, new in kept.items()], "prediction", "probability")


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> str:
    closed = isinstance(bundle.model, GaussianModel)
    scaler, sign = bundle.scaler, bundle.components.sign if bundle.components else None
    meta = ("gaussian" if closed else "forest", list(bundle.features), list(scaler.mean) if scaler else None,
            list(scaler.std) if scaler else None, list(sign) if sign else None)
    spark.createDataFrame([meta], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if closed:
        bundle.model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    else:
        bundle.model.write().overwrite().save(f"{path}/model")
    if bundle.components:
        bundle.components.model.write().overwrite().save(f"{path}/components")
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    meta = spark.read.parquet(f"{path}/meta").first()
    features = tuple(meta["features"])
    if meta["kind"] == "gaussian":
        return Bundle(features, GaussianModel.from_table(spark.read.parquet(f"{path}/model"), features))
    scaler = Scaler(features, tuple(meta["mean"]), tuple(meta["std"])) if meta["mean"] is not None else None
    components = Components(PCAModel.load(f"{path}/components"), tuple(meta["sign"])) if meta["sign"] is not None else None
    return Bundle(features, PipelineModel.load(f"{path}/model"), scaler, components)


def new_version(versions: DataFrame, model: str, bundle: str, environment: str, ts: Column, training_run_id: str) -> DataFrame:
    """The row that a finished run adds to the versions: the model's next number, in no stage."""
    last = versions.where(F.col("model") == model).agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    return last.select(
        F.lit(model).alias("model"), (F.col("last") + 1).cast("int").alias("number"), F.lit(None).cast("string").alias("stage"),
        F.lit(environment).alias("environment"), F.lit(bundle).alias("bundle"), F.lit(training_run_id).alias("training_run_id"),
        ts.alias("created"))


class NoVersionError(LookupError):
    """A model has no version to score with."""


def resolve(versions: DataFrame, model: str, stage: str, fall_back: bool = False) -> tuple[int, str]:
    """Number and folder of the version in the stage; with ``fall_back`` the newest version if the stage is empty."""
    mine = versions.where(F.col("model") == model)
    held = stage_holders(mine).select(F.col(stage).alias("held"), F.col("latest").alias("newest")).first()
    number = None if held is None else held["held"] if held["held"] is not None or not fall_back else held["newest"]
    if number is None:
        raise NoVersionError(f"{model} has no version in {stage}")
    return number, mine.where(F.col("number") == number).first()["bundle"]


def score_stage(df: DataFrame, versions: DataFrame, model: str, stage: str, keep: Sequence[str], fall_back: bool = False) -> DataFrame:
    """Score with the stored version that holds the stage; the rows say which stage and version that was."""
    number, path = resolve(versions, model, stage, fall_back)
    return load_bundle(df.sparkSession, path).score(df, keep).withColumns(
        {"model_stage": F.lit(stage), "model_version": F.lit(str(number))})
