"""Exact classification metrics, for a whole table or per segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.running import default_buckets, value_buckets
from tollgate.functions.scalars import flag_sum, ratio
from tollgate.sources.artifacts import materialize


def confusion_counts(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    y, hit = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        flag_sum((y == 1) & (hit == 1)).alias("tp"),
        flag_sum((y == 0) & (hit == 1)).alias("fp"),
        flag_sum((y == 1) & (hit == 0)).alias("fn"),
        flag_sum((y == 0) & (hit == 0)).alias("tn"),
    )


def _rates() -> list[Column]:
    """Rows and the four rates from the confusion counts; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn", "tn"))
    return [
        (tp + fp + fn + tn).alias("n"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    ]


def binary_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 with class 1 as the positive class."""
    return confusion_counts(df, by, label, prediction).select(*by, *_rates())


def _score_counts(df: DataFrame, by: Sequence[str], label: str, score: str, prediction: str | None) -> DataFrame:
    """Rows per distinct score: positives, negatives, and how many of each are predicted 1.

    A row without a prediction takes no part, as in :func:`binary_metrics`. The counts are written once: their limits and
    their sums are two readings, and everything before them is computed once.
    """
    if prediction:
        df = df.where(F.col(prediction).isNotNull())
    y = F.col(label)
    hit = F.col(prediction) == 1 if prediction else F.lit(False)
    return materialize(df.groupBy(*by, F.col(score).alias("score")).agg(
        flag_sum(y == 1).alias("pos"), flag_sum(y == 0).alias("neg"),
        flag_sum((y == 1) & hit).alias("pos_hit"), flag_sum((y == 0) & hit).alias("neg_hit")), "score_counts")


def _ranked_sums(per_score: DataFrame, by: Sequence[str], buckets: int | None) -> DataFrame:
    """Per group: the confusion counts, and the pairs of a positive and a negative that the score orders rightly.

    Scores are spread over buckets of about equal size, in order. A bucket counts its own pairs; pairs of a positive
    with the negatives of lower buckets follow from the bucket totals alone, so no row has to learn its global rank.
    Everything but the last, small aggregate is shuffled by (group, bucket) once.
    """
    bucketed = value_buckets(per_score, "score", buckets or default_buckets(per_score))
    inside = Window.partitionBy(*by, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    per_bucket = (
        bucketed.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2.0))
        .groupBy(*by, "bucket")
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pos_hit", "neg_hit", "wins")])
    )
    lower = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("wins") + F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    return per_bucket.withColumn("wins", wins).groupBy(*by).agg(
        F.sum("pos_hit").alias("tp"),
        F.sum("neg_hit").alias("fp"),
        (F.sum("pos") - F.sum("pos_hit")).alias("fn"),
        (F.sum("neg") - F.sum("neg_hit")).alias("tn"),
        F.sum("wins").alias("wins"),
    )


def _area() -> Column:
    pairs = (F.col("tp") + F.col("fn")).cast("double") * (F.col("fp") + F.col("tn")).cast("double")
    return F.col("wins") / F.nullif(pairs, F.lit(0.0))


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "probability",
            buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve; ties count one half, and one class alone gives null."""
    per_score = _score_counts(df, by, label, score, None)
    return _ranked_sums(per_score, by, buckets).select(*by, _area().alias("roc_auc"))


def evaluate(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "probability",
             prediction: str = "prediction", buckets: int | None = None) -> DataFrame:
    """All five metrics from one aggregate of the scored table, for the whole table or per group."""
    counts = _ranked_sums(_score_counts(df, by, label, score, prediction), by, buckets)
    return counts.select(*by, *_rates(), _area().alias("roc_auc"))


def metric_rows(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per metric."""
    present = [m for m in P.METRICS if m in metrics.columns]
    if by:
        return metrics.unpivot(list(by), present, "metric", "value")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in present])
    return metrics.select(F.inline(pairs))


def high_risk_summary(df: DataFrame, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """How many rows are predicted 1, and their percentage; 0.0 on no rows."""
    hits = flag_sum(F.col(prediction) == 1)
    rows = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        rows.alias("total"), hits.alias("high_risk"), (ratio(hits, rows) * 100).alias("high_risk_pct"))


def performance_rows(metric_table: DataFrame, minimum: dict, by: Sequence[str] = ()) -> DataFrame:
    """All five metrics of each version with threshold and result: PASS or FAIL, and INFO where there is no threshold.

    A metric that is missing counts as 0.
    """
    wide = metric_table.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in P.METRICS])
    def row(metric: str) -> Column:
        actual = F.coalesce(F.col(metric), F.lit(0.0))
        limit = F.lit(minimum.get(metric)).cast("double")
        result = F.when(limit.isNull(), "INFO").when(actual >= limit, "PASS").otherwise("FAIL")
        return F.struct(F.lit(metric).alias("metric"), limit.alias("threshold"), actual.alias("actual"), result.alias("result"))
    return wide.select(*by, F.inline(F.array(*[row(m) for m in P.METRICS])))
