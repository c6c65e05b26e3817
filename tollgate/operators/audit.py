"""Audit export, retention, run clean-up, approvals and the sampled prediction log (described in guides only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import key_hash
from tollgate.sources.artifacts import materialize


def audit_log(promotions: DataFrame, runs: DataFrame, project: str = P.PROJECT) -> DataFrame:
    """Promotions and runs in one shape, with their date, and the month to partition the table by."""
    promoted = promotions.select(
        F.lit("model_promotion").alias("event_type"),
        F.concat("model", F.lit("/"), F.col("number").cast("string"), F.lit("/"), F.col("seq").cast("string")).alias("subject"),
        F.concat("from_stage", F.lit(" -> "), "to_stage").alias("detail"),
        "ts")
    ran = runs.select(
        F.lit("pipeline_run").alias("event_type"), F.col("run_id").alias("subject"),
        F.concat("flow", F.lit(" "), "status").alias("detail"), F.col("start_time").alias("ts"))
    both = promoted.unionByName(ran)
    return both.select(
        "*", F.lit(project).alias("project"), F.to_date("ts").alias("date"), F.trunc("ts", "month").alias("month"))


def audit_export(log: DataFrame, start: str, end: str, event_types: Sequence[str], project: str) -> DataFrame:
    """Rows of the given days, types and project. Both days count. The filter on the month prunes partitions."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    return log.where(
        F.col("month").between(F.trunc(first, "month"), F.trunc(last, "month"))
        & F.col("date").between(first, last)
        & F.col("event_type").isin(*event_types) & (F.col("project") == project))


def retained(log: DataFrame, as_of: str, tier: str = "standard") -> DataFrame:
    """Rows no older than the tier keeps them."""
    oldest = F.date_sub(F.to_date(F.lit(as_of)), P.RETENTION_DAYS[tier])
    return log.where((F.col("month") >= F.trunc(oldest, "month")) & (F.col("date") >= oldest))


def retention_plan(log: DataFrame, as_of: str, tier: str = "standard") -> DataFrame:
    """The dry run: per month what is kept and removed, and whether its partition is kept, dropped or rewritten."""
    oldest = F.date_sub(F.to_date(F.lit(as_of)), P.RETENTION_DAYS[tier])
    kept = F.count_if(F.col("date") >= oldest)
    months = log.groupBy("month").agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("removed"))
    action = F.when(F.col("removed") == 0, "keep").when(F.col("kept") == 0, "drop").otherwise("rewrite")
    return months.withColumn("action", action)


def apply_retention(spark: SparkSession, path: str, as_of: str, tier: str = "standard") -> DataFrame:
    """Remove from a log that is stored by month what is older than the tier keeps, and return the plan that was carried out.

    Months without anything to keep go as folders, the month in which the border lies is written anew, and all other files stay as they are.
    A repeated call finds nothing more to remove. Dropping comes last, so a call that fails in between can be repeated.
    """
    log = spark.read.parquet(path)
    plan = materialize(retention_plan(log, as_of, tier), "retention")
    months = {r["month"]: r["action"] for r in plan.collect()}  # as many rows as months
    border = [m for m, action in months.items() if action == "rewrite"]
    if border:
        kept = materialize(retained(log.where(F.col("month").isin(border)), as_of, tier), "border")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    fs = spark._jvm.org.apache.hadoop.fs
    for month, action in months.items():
        if action == "drop":
            folder = fs.Path(f"{path}/month={month}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return plan


def keep_last_runs(runs: DataFrame, keep: int = P.KEEP_LAST_RUNS, by: str = "flow") -> DataFrame:
    """The newest runs of each flow. Spark applies the rank limit before the shuffle, so each task sends ``keep`` rows."""
    newest = Window.partitionBy(by).orderBy(F.col("start_time").desc(), F.col("run_id").desc())
    return runs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep)


def approval_gate(approvals: DataFrame, stage: str) -> DataFrame:
    """Per request the distinct approvers with an allowed role, and whether they are enough for the stage."""
    allowed = F.col("role").isin(*P.APPROVAL_ROLES[stage])
    per_approver = approvals.groupBy("model", "number", "approver").agg(F.max(allowed).alias("allowed"))
    return per_approver.groupBy("model", "number").agg(
        F.count(F.lit(1)).alias("approvers"),
        F.sum(F.col("allowed").cast("int")).cast("bigint").alias("allowed_approvers"),
    ).withColumn("approved", F.col("allowed_approvers") >= P.MIN_APPROVERS[stage])


def sampled_log(predictions: DataFrame, key: str, share: float = 0.1, salt: object = "log") -> DataFrame:
    """A fixed share of the predictions by key hash: a filter, the same rows on every run. 0 keeps none and 1 all."""
    if not 0 <= share <= 1:
        raise ValueError(f"a share lies between 0 and 1, not at {share}")
    number = F.conv(F.substring(key_hash(key, salt), 1, 6), 16, 10).cast("int")
    return predictions.where(number < int(share * 16**6))
