"""Drift between a reference and a current table (described in guides only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.running import running_totals
from tollgate.sources.artifacts import materialize

BINS = 10
EMPTY_SHARE = 1e-4  # share used for an empty bin
DRIFTED_PSI = 0.2


def _psi(reference, current):
    a, b = F.greatest(reference, F.lit(EMPTY_SHARE)), F.greatest(current, F.lit(EMPTY_SHARE))
    return (b - a) * F.log(b / a)


def numeric_drift(df: DataFrame, columns: Sequence[str], is_current: str = "is_current", bins: int = BINS,
                  buckets: int | None = None) -> DataFrame:
    """Per numeric column: population stability index over reference quantile bins, and the KS distance. Both exact.

    Values are counted first, then each distinct value learns how many reference and current rows lie below it. Its bin
    follows from the reference share below it, so no quantile has to be known beforehand.
    """
    long = df.unpivot([is_current], list(columns), "column", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    counted = materialize(long.groupBy("column", "value").agg(
        F.sum(F.when(F.col(is_current), 0).otherwise(1)).alias("ref"),
        F.sum(F.when(F.col(is_current), 1).otherwise(0)).alias("cur")), "value_counts")
    ranked = running_totals(counted, "value", ["ref", "cur"], ["column"], buckets)
    share = lambda part, whole: part / F.nullif(whole.cast("double"), F.lit(0.0))
    gap = F.abs(share(F.col("ref_below") + F.col("ref"), F.col("ref_total"))
                - share(F.col("cur_below") + F.col("cur"), F.col("cur_total")))
    position = F.floor(F.col("ref_below") * bins / F.nullif(F.col("ref_total"), F.lit(0)))
    binned = ranked.select(
        "column", F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).alias("bin"), "ref", "cur", "ref_total",
        "cur_total", gap.alias("gap"))
    per_bin = binned.groupBy("column", "bin", "ref_total", "cur_total").agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur"), F.max("gap").alias("gap"))
    psi = _psi(share(F.col("ref"), F.col("ref_total")), share(F.col("cur"), F.col("cur_total")))
    return per_bin.groupBy("column").agg(F.sum(psi).alias("psi"), F.max("gap").alias("ks"))


def category_drift(df: DataFrame, column: str, is_current: str = "is_current") -> DataFrame:
    """The same index over the categories of one text column."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.sum(F.when(F.col(is_current), 0).otherwise(1)).alias("ref"),
        F.sum(F.when(F.col(is_current), 1).otherwise(0)).alias("cur"))
    # The two totals are scalar subqueries: one number each, whatever the number of categories.
    share = lambda part: F.col(part) / F.nullif(counted.agg(F.sum(part).cast("double")).scalar(), F.lit(0.0))
    psi = _psi(share("ref"), share("cur"))
    return counted.select(psi.alias("psi")).agg(F.sum("psi").alias("psi")).select(
        F.lit(column).alias("column"), "psi", F.lit(None).cast("double").alias("ks"))


def drift_columns(df: DataFrame, numeric: Sequence[str], categories: Sequence[str] = (),
                  is_current: str = "is_current") -> DataFrame:
    rows = numeric_drift(df, numeric, is_current)
    for column in categories:
        rows = rows.unionByName(category_drift(df, column, is_current))
    return rows.withColumn("drifted", F.col("psi") > DRIFTED_PSI)


def drift_score(columns: DataFrame, limit: float = P.DRIFT_ALERT, by: Sequence[str] = ()) -> DataFrame:
    """Share of drifted columns; alert (and retrain) if it is above the limit."""
    drifted = F.sum(F.col("drifted").cast("int"))
    score = columns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_columns"), drifted.cast("bigint").alias("n_drifted"),
        (drifted / F.count(F.lit(1))).alias("drift_score"))
    return score.withColumn("alert", F.col("drift_score") > limit)


def retrain_trigger(score: DataFrame) -> DataFrame:
    return score.withColumn("retrain", F.col("alert"))


def reference_profile(df: DataFrame, numeric: Sequence[str], categories: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """What drift needs of a reference table, to be stored once: ``column, edges, bin, n``.

    A numeric column has the values that cut it into ``bins`` parts of equal size, exact, and the rows in each part; a text
    column its categories (``edges`` is null) and their rows. Its size is that of the bins and categories.
    """
    long = df.unpivot([], list(numeric), "column", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = materialize(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "value_counts")
    ranked = running_totals(counted, "value", ["n"], ["column"])
    # The cut after a share of the rows is the value of the row that completes it.
    place = lambda i: F.ceil(F.col("n_total") * F.lit(i) / F.lit(bins))
    cuts = [F.min(F.when(F.col("n_below") + F.col("n") >= place(i), F.col("value"))).alias(f"e{i}") for i in range(1, bins)]
    edges = ranked.groupBy("column").agg(*cuts).select("column", F.array(*[f"e{i}" for i in range(1, bins)]).alias("edges"))
    return fold_profile(df, materialize(edges, "edges"), categories)


def fold_profile(df: DataFrame, profile: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """The profile of another table over the numeric columns and edges of ``profile``: one pass, a few rows per task."""
    edges = [(r["column"], r["edges"]) for r in profile.where("edges IS NOT NULL").select("column", "edges").distinct().collect()]
    parts = []
    for column, cuts in edges:
        value = F.col(column).cast("double")
        place = sum(((value > F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("string")
        parts.append(F.struct(F.lit(column).alias("column"), F.lit(cuts).cast("array<double>").alias("edges"),
                              F.when(F.col(column).isNotNull() & ~F.isnan(value), place).alias("bin")))
    for column in categories:
        parts.append(F.struct(F.lit(column).alias("column"), F.lit(None).cast("array<double>").alias("edges"), F.col(column).cast("string").alias("bin")))
    rows = df.select(F.inline(F.array(*parts))).where("bin IS NOT NULL")
    return rows.groupBy("column", "edges", "bin").agg(F.count(F.lit(1)).alias("n"))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of all tables together. Those with the same edges add up; categories that only some have are kept."""
    whole = profiles[0]
    for more in profiles[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("column", "edges", "bin").agg(F.sum("n").alias("n"))


def drift_from_profile(reference: DataFrame, current: DataFrame) -> DataFrame:
    """``column, psi, drifted`` of two profiles over the same edges. A bin or category that one of them lacks counts as empty there."""
    both = reference.select("column", "bin", F.col("n").alias("ref"), F.lit(0).cast("long").alias("cur")).unionByName(
        current.select("column", "bin", F.lit(0).cast("long").alias("ref"), F.col("n").alias("cur")))
    bins = materialize(both.groupBy("column", "bin").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur")), "bins")
    totals = bins.groupBy("column").agg(F.sum("ref").cast("double").alias("refs"), F.sum("cur").cast("double").alias("curs"))
    share = lambda part, whole: F.col(part) / F.nullif(F.col(whole), F.lit(0.0))
    joined = bins.join(totals, "column")
    return joined.groupBy("column").agg(F.sum(_psi(share("ref", "refs"), share("cur", "curs"))).alias("psi")).withColumn(
        "drifted", F.col("psi") > DRIFTED_PSI)
