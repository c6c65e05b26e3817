"""Champion against challenger, row by row and by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import flag_sum, ratio


def _side_by_side(champion: DataFrame, challenger: DataFrame, key: str, segments: Sequence[str]) -> DataFrame:
    """One row per key with the values of both sides and the rows each side has for it.

    A union and one group-by do the work of a full outer join on unique keys. A key that either table repeats folds on
    the map side; a join would give all pairs of its rows.
    """
    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(key, *segments, "prediction", "probability", F.lit(side).alias("side"))

    both = tagged(champion, 0).unionByName(tagged(challenger, 1))
    def of(side: int, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))
    return both.groupBy(key).agg(
        *[F.max(s).alias(s) for s in segments],
        of(0, "prediction").alias("champion_prediction"),
        of(0, "probability").alias("champion_probability"),
        of(1, "prediction").alias("challenger_prediction"),
        of(1, "probability").alias("challenger_probability"),
        flag_sum(F.col("side") == 0).alias("champion_rows"),
        flag_sum(F.col("side") == 1).alias("challenger_rows"),
    )


def align(champion: DataFrame, challenger: DataFrame, key: str, segments: Sequence[str] = ()) -> DataFrame:
    """Keys that both sides have exactly once, with both predictions and the probability difference."""
    rows = _side_by_side(champion, challenger, key, segments)
    return rows.where((F.col("champion_rows") == 1) & (F.col("challenger_rows") == 1)).select(
        key, *segments,
        "champion_prediction", "champion_probability", "challenger_prediction", "challenger_probability",
        F.abs(F.col("champion_probability") - F.col("challenger_probability")).alias("probability_diff"),
    )


def alignment_counts(champion: DataFrame, challenger: DataFrame, key: str) -> DataFrame:
    """How many keys match, are on one side only, or are repeated and so cannot be aligned."""
    rows = _side_by_side(champion, challenger, key, ())
    a, b = F.col("champion_rows"), F.col("challenger_rows")
    return rows.agg(
        flag_sum((a == 1) & (b == 1)).alias("matched"),
        flag_sum((a > 0) & (b == 0)).alias("champion_only"),
        flag_sum((a == 0) & (b > 0)).alias("challenger_only"),
        flag_sum((a > 1) | (b > 1)).alias("repeated"),
    )


def comparison(aligned: DataFrame, champion_version: object = None, challenger_version: object = None,
               by: Sequence[str] = ()) -> DataFrame:
    """Agreement rate, both positive rates, mean and largest probability difference, in one aggregate."""
    n = F.count(F.lit(1))
    a, b = F.col("champion_prediction"), F.col("challenger_prediction")
    versions = []
    if champion_version is not None:
        versions = [F.lit(str(champion_version)).alias("champion_version"),
                    F.lit(str(challenger_version)).alias("challenger_version")]
    summary = aligned.groupBy(*by).agg(
        n.alias("total_samples"),
        ratio(flag_sum(a == b), n).alias("agreement_rate"),
        ratio(flag_sum(a == 1), n).alias("champion_positive_rate"),
        ratio(flag_sum(b == 1), n).alias("challenger_positive_rate"),
        F.avg("probability_diff").alias("avg_probability_diff"),
        F.max("probability_diff").alias("max_probability_diff"),
    )
    return summary.select(*by, *versions, *[c for c in summary.columns if c not in by])


def recommendation() -> Column:
    """From a comparison row: safe needs high agreement and a small mean difference; then review, then caution."""
    agreement, difference = F.col("agreement_rate"), F.col("avg_probability_diff")
    return (
        F.when((agreement >= P.SAFE_AGREEMENT) & (difference < P.SAFE_DIFFERENCE), P.RECOMMENDATIONS["safe"])
        .when(agreement >= P.REVIEW_AGREEMENT, P.RECOMMENDATIONS["review"])
        .otherwise(P.RECOMMENDATIONS["caution"])
    )


def disagreements(aligned: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows where the predictions differ, largest difference first; ``limit`` makes it a top-k report."""
    differing = aligned.where(F.col("champion_prediction") != F.col("challenger_prediction"))
    if limit is None:
        return differing
    return differing.orderBy(F.col("probability_diff").desc(), key).limit(limit)
