"""Champion against challenger as one flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.operators.compare import comparison, recommendation
from tollgate.operators.models import GaussianModel
from tollgate.operators.scoring import score, score_by_stage


def scored_pair(df: DataFrame, keep: Sequence[str], champion: GaussianModel, challenger: GaussianModel,
                champion_version: object = 1, challenger_version: object = 2) -> tuple[DataFrame, DataFrame]:
    return (
        score_by_stage(champion, df, keep, "staging", champion_version),
        score_by_stage(challenger, df, keep, "challenger", challenger_version),
    )


def score_side_by_side(df: DataFrame, keep: Sequence[str], champion: GaussianModel, challenger: GaussianModel) -> DataFrame:
    """Both models on each row of one table, in the shape of aligned predictions: one projection, no shuffle.

    Predictions that were stored apart are brought together by :func:`tollgate.operators.compare.align`.
    """
    first = score(champion, df, df.columns).withColumnsRenamed(
        {"prediction": "champion_prediction", "probability": "champion_probability"})
    both = score(challenger, first, [*keep, "champion_prediction", "champion_probability"])
    return both.select(
        *keep, "champion_prediction", "champion_probability",
        F.col("prediction").alias("challenger_prediction"),
        F.col("probability").alias("challenger_probability"),
        F.abs(F.col("champion_probability") - F.col("probability")).alias("probability_diff"),
    )


def compare_models(df: DataFrame, key: str, champion: GaussianModel, challenger: GaussianModel,
                   champion_version: object = 1, challenger_version: object = 2) -> DataFrame:
    """One row: the comparison and what it recommends."""
    aligned = score_side_by_side(df, [key], champion, challenger)
    return comparison(aligned, champion_version, challenger_version).withColumn("recommendation", recommendation())
