"""The state that held when something happened: an as-of join without comparing all pairs and without one window per key.

Time is cut into spans. A span's changes are kept as one short ordered list per key, and what held when the span began is carried
over from the spans before. A row then meets exactly one line, that of its key and span, so a key with most of the rows
is spread over its spans, and Spark splits a span that is still too large, as the other side is unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.operators.registry import stage_history


def as_of(rows: DataFrame, changes: DataFrame, by: Sequence[str], ts: str, change_ts: str, values: Sequence[str],
          span_seconds: int = 86_400) -> DataFrame:
    """All rows, with ``values`` of the last change of the same key at or before ``ts``; null if there is none.

    Of changes at the same time the one with the larger values counts, null being smallest. A row with a null
    key or time meets no change. ``span_seconds`` sets how many changes share a line and how many lines a key has; it
    does not affect the result.
    """
    span = lambda name: F.floor(F.unix_micros(F.col(name).cast("timestamp")) / (span_seconds * 1_000_000)).cast("long")
    keys = list(by)
    known = changes.where(F.col(change_ts).isNotNull()).select(
        *keys, span(change_ts).alias("__span"), F.struct(F.col(change_ts).alias("at"), *values).alias("change"))
    lines = known.groupBy(*keys, "__span").agg(F.sort_array(F.collect_list("change")).alias("changes"))
    spanned = rows.withColumn("__span", span(ts))
    # The spans in which something is asked or changes, one line each: as many as there are spans, not rows.
    asked = spanned.select(*keys, "__span").where(F.col("__span").isNotNull()).distinct()
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    every = asked.unionByName(lines.select(*keys, "__span")).distinct().join(lines, [*keys, "__span"], "left")
    carried = every.select(*keys, "__span", F.coalesce("changes", F.array().cast(lines.schema["changes"].dataType)).alias("changes"),
                           F.last(F.get("changes", F.size("changes") - 1), ignorenulls=True).over(before).alias("carried"))
    met = spanned.join(carried, [*keys, "__span"], "left")
    inside = F.filter("changes", lambda c: c["at"] <= F.col(ts))
    held = F.coalesce(F.get(inside, F.size(inside) - 1), F.col("carried"))
    return met.withColumn("__held", held).select(*[F.col(c) for c in rows.columns], *[F.col("__held")[v].alias(v) for v in values])


def production_changes(events: DataFrame) -> DataFrame:
    """``model, at, production``: when a version enters production, and when one leaves it (null from then on)."""
    moves = stage_history(events).select("model", "number", "stage", "previous_stage", "ts")
    entered = moves.where("stage = 'production'").select("model", F.col("ts").alias("at"), F.col("number").alias("production"))
    left = moves.where("previous_stage = 'production' AND stage <> 'production'").select(
        "model", F.col("ts").alias("at"), F.lit(None).cast("int").alias("production"))
    return entered.unionByName(left)
