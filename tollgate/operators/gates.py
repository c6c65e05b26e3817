"""Metric gates over every version at once, with the four meanings of a missing metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import three_places

VERSION = ("model", "number")


class GateError(ValueError):
    """A gate did not pass."""


def metric_columns(metrics: DataFrame, by: Sequence[str] = VERSION, names: Sequence[str] = P.GATED_METRICS) -> DataFrame:
    """Long metric table to one row per version with a column per metric; null where the metric is missing."""
    return metrics.where(F.col("metric").isin(*names)).groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])


def _failure(gate: P.Gate, metric: str, minimum: float) -> Column:
    value = F.col(metric)
    if gate.on_missing == "zero":
        value = F.coalesce(value, F.lit(0.0))
        text = F.concat(F.lit(metric.capitalize() + " "), three_places(value), F.lit(f" < {minimum:.3f}"))
        return F.when(value < minimum, text)
    tail = {"error": f" < {minimum:.3f} (required)", "fail": f" < {minimum:.3f}", "skip": f" < {minimum}"}
    text = F.concat(F.lit(f"{metric}: "), three_places(value), F.lit(tail[gate.on_missing]))
    failure = F.when(value < minimum, text)
    if gate.on_missing == "fail":
        failure = F.when(value.isNull(), F.lit(f"{metric}: missing (required >= {minimum})")).otherwise(failure)
    return failure


def gate_columns(gate: P.Gate, strict_nan: bool = False) -> list[Column]:
    """outcome (PASS, FAIL or ERROR) and the list of failures, from the metric columns of a row."""
    missing = F.lit(False)
    if gate.on_missing == "error":
        for metric in P.GATED_METRICS:
            missing = missing | F.col(metric).isNull()
    absent = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(f"missing {m}")) for m in P.GATED_METRICS]))
    texts = [_failure(gate, m, minimum) for m, minimum in gate.minimum.items()]
    if strict_nan:
        texts += [F.when(F.isnan(m), F.lit(f"{m}: not a number")) for m in gate.minimum]
    below = F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")
    failures = F.when(missing, absent).otherwise(below)
    outcome = F.when(missing, "ERROR").when(F.size(below) > 0, "FAIL").otherwise("PASS")
    return [F.lit(gate.name).alias("gate"), outcome.alias("outcome"), failures.alias("failures")]


def apply_gate(versions: DataFrame, metrics: DataFrame, gate: P.Gate, by: Sequence[str] = VERSION,
               strict_nan: bool = False) -> DataFrame:
    """One verdict per version. Metrics are folded per version first, so the join has one row on each side."""
    return versions.select(*by).join(metric_columns(metrics, by), list(by), "left").select(
        *by, *gate_columns(gate, strict_nan))


def gate_for_workspace(name: str) -> P.Gate:
    """An unknown destination has no requirement."""
    return P.WORKSPACE_GATES.get(name, P.Gate(name, {}, "fail"))


def gate_row(metrics: DataFrame, gate: P.Gate) -> DataFrame:
    """The verdict of one row of metric columns, with its other columns kept."""
    return metrics.select(*metrics.columns, *gate_columns(gate))


def require_gate(metrics: DataFrame, gate: P.Gate) -> bool:
    """True, or raise with every failure. ``metrics`` is one aggregated row."""
    row = gate_row(metrics, gate).first()
    if row["outcome"] != "PASS":
        raise GateError("; ".join(row["failures"]))
    return True


def metric_status(versions: DataFrame, metrics: DataFrame, gate: P.Gate, by: Sequence[str] = VERSION) -> DataFrame:
    """One row per version and gated metric: PASS, FAIL or MISSING, and whether the version passes in all."""
    wide = versions.select(*by).join(metric_columns(metrics, by), list(by), "left")
    def status(metric: str, minimum: float) -> Column:
        value = F.col(metric)
        return F.when(value.isNull(), "MISSING").when(value >= minimum, "PASS").otherwise("FAIL")
    each = {m: status(m, minimum) for m, minimum in gate.minimum.items()}
    passes = F.lit(True)
    for s in each.values():
        passes = passes & (s == "PASS")
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(gate.minimum[m]).alias("minimum"), F.col(m).alias("value"), s.alias("status"))
        for m, s in each.items()
    ])
    return wide.select(*by, passes.alias("version_passes"), F.inline(rows))


def overall_decision(checks: DataFrame, by: Sequence[str] = (), result: str = "result") -> DataFrame:
    """PASSED iff no check row failed; warnings and information do not count."""
    failed = F.coalesce(F.sum(F.when(F.col(result) == "FAIL", 1).otherwise(0)), F.lit(0))
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"), failed.alias("failed_checks")).withColumn(
        "decision", F.when(F.col("failed_checks") == 0, "PASSED").otherwise("FAILED"))


def after_run_decision(rows: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Per version: passed iff no performance row failed and its training run is completed."""
    decided = overall_decision(rows, VERSION)
    status = versions.select(*VERSION, F.col("training_run_id").alias("run_id")).join(
        runs.select("run_id", F.col("status").alias("run_status")), "run_id", "left")
    completed = F.coalesce(F.col("run_status") == "completed", F.lit(False))
    return decided.join(status, list(VERSION)).select(
        *VERSION, "failed_checks", "run_status",
        F.when((F.col("failed_checks") == 0) & completed, "PASSED").otherwise("FAILED").alias("decision"))
