"""Applying a model to a table: plain, with record id, or tagged with stage and version."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import params as P
from tollgate.functions.scalars import reasons, risk_tier, round_probability, short_id
from tollgate.operators.models import GaussianModel


def score(model: GaussianModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns, prediction and probability of class 1: one projection, no shuffle."""
    return df.select(*keep, model.log_odds().alias("__z")).select(
        *keep,
        (F.col("__z") > 0).cast("int").alias("prediction"),
        (1 / (1 + F.exp(-F.col("__z")))).alias("probability"),
    )


def score_with_id(model: GaussianModel, df: DataFrame, key: str) -> DataFrame:
    return score(model, df, [key]).select(
        F.col(key).alias("patient_id"),
        F.col("prediction").alias("readmission_risk"),
        F.col("probability").alias("risk_probability"),
    )


def score_by_stage(model: GaussianModel, df: DataFrame, keep: Sequence[str], stage: str, version: object) -> DataFrame:
    return score(model, df, keep).withColumns({
        "model_stage": F.lit(stage), "model_version": F.lit(str(version))})


def score_in_pandas(df: DataFrame, keep: Sequence[str], feature_columns: Sequence[str],
                    load_model: Callable[[], object]) -> DataFrame:
    """Score with a Python model that has ``predict_proba``, for models trained elsewhere.

    ``load_model`` runs once per task and reads the model from shared storage. Rows travel in Arrow batches, and only
    the kept and the feature columns.
    """
    kept = df.select(*keep).schema
    out = T.StructType([*kept.fields, T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.DoubleType())])
    columns, names = list(feature_columns), list(keep)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            p = np.asarray(model.predict_proba(batch[columns].to_numpy(dtype=float)))[:, 1]
            yield batch[names].assign(prediction=(p > 0.5).astype("int32"), probability=p)

    return df.select(*dict.fromkeys([*names, *columns])).mapInPandas(apply, out)


def respond(model: GaussianModel, requests: DataFrame, version: object, key: str = "event_id") -> DataFrame:
    """The answer to each request: id, prediction, rounded probability, tier, version and reasons."""
    fields = list(P.REQUEST_DEFAULTS)
    kept = [c for c in requests.columns if c not in fields and c != "unknown_fields"]
    return answers(score(model, requests, [*kept, *fields]), kept, version, key)


def answers(scored: DataFrame, kept: Sequence[str], version: object, key: str = "event_id") -> DataFrame:
    """The answers from requests with their fields, prediction and probability, whichever model made these."""
    return scored.select(
        *kept,
        short_id(key).alias("patient_id"),
        "prediction",
        round_probability("probability").alias("probability"),
        risk_tier("probability").alias("risk_level"),
        F.lit(str(version)).alias("model_version"),
        F.struct(
            reasons(P.RISK_REASONS).alias("top_risk_factors"),
            reasons(P.PROTECTIVE_REASONS).alias("protective_factors"),
        ).alias("explanation"),
    )
