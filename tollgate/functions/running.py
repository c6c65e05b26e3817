"""Running totals over a global order without sending the table to one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_buckets(df: DataFrame, order: str, buckets: int, bucket: str = "bucket") -> DataFrame:
    """Add an order-preserving bucket number, with about as many rows in each bucket.

    The limits come from an approximate quantile sketch, so they affect only the balance, never a result. At most
    ``buckets`` numbers reach the driver.
    """
    shares = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(order, shares, 0.5 / buckets) if buckets > 1 else []
    limits = sorted({x for x in found if isfinite(x)})  # values at infinity fall into the outer buckets
    if not limits:
        return df.withColumn(bucket, F.lit(0.0))
    splits = [float("-inf"), *limits, float("inf")]
    return Bucketizer(splits=splits, inputCol=order, outputCol=bucket, handleInvalid="keep").transform(df)


def default_buckets(df: DataFrame) -> int:
    """One bucket per shuffle partition: the size the cluster was set up for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_below(bucketed: DataFrame, sums: Sequence[str], by: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """Per group and bucket: the totals of ``sums`` in all lower buckets (``<c>_lower``) and in the group (``<c>_total``).

    The windows here see one row per bucket, so the largest has as many rows as there are buckets.
    """
    totals = bucketed.groupBy(*by, bucket).agg(*[F.sum(c).alias(c) for c in sums])
    lower = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return totals.select(
        *by,
        bucket,
        *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"{c}_lower") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
    )


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (),
                   buckets: int | None = None) -> DataFrame:
    """Add ``<c>_below`` (total of ``c`` over smaller ``order`` values of the group) and ``<c>_total`` for each sum.

    ``order`` must be unique within the group: aggregate per value first, which also folds a hot value into one row.
    One shuffle spreads the rows by (group, bucket); a hot group is spread over all buckets.
    """
    bucketed = value_buckets(df, order, buckets or default_buckets(df))
    inside = Window.partitionBy(*by, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = bucketed.select(
        *bucketed.columns,
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_within") for c in sums],
    )
    keys = [*by, "bucket"]
    lower = bucket_below(bucketed, sums, by).select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[f"{c}_lower" for c in sums],
        *[f"{c}_total" for c in sums],
    )
    same_bucket = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return within.join(lower, same_bucket).select(
        *df.columns,
        *[(F.col(f"{c}_within") + F.col(f"{c}_lower")).alias(f"{c}_below") for c in sums],
        *[F.col(f"{c}_total") for c in sums],
    )
