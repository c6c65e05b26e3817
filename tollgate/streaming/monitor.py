"""Live summary of a score stream by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tollgate.functions.scalars import flag_sum, ratio


def window_summary(scores: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Rows, positive rate and mean probability per tumbling window. Rows older than the watermark are dropped.

    The watermark bounds the state: a window leaves it once it is closed and written.
    """
    n = F.count(F.lit(1))
    return (
        scores.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(n.alias("n"), ratio(flag_sum(F.col("prediction") == 1), n).alias("positive_rate"),
             F.avg("probability").alias("mean_probability"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "n", "positive_rate", "mean_probability")
    )


def start_monitor(summary: DataFrame, output: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write every closed window once. A window is closed when the watermark has passed its end; the last ones of a stream
    that has ended are written by :func:`closing_rows`."""
    return (
        summary.writeStream.format("parquet").outputMode("append").option("path", output)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def closing_rows(scores: DataFrame, width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Rows to append to a stream that has ended, so that its last windows close: one row without a score, a window and
    a year after the last. Its own window stays open and is never written."""
    return scores.agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull()).select(
        (F.col(ts) + F.expr(f"INTERVAL {width}") + F.expr("INTERVAL 1 YEAR")).alias(ts))
