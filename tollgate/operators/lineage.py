"""From a prediction back to model, run, data and commit; run metrics, durations and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import flag_sum
from tollgate.operators.registry import stage_holders
from tollgate.sources.artifacts import materialize


def lineage_trace(versions: DataFrame, runs: DataFrame, artifacts: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Per model the production version (else the one in staging), its run, its data outputs and its commit.

    Every link may be missing and is null then. Predictions are counted per version before they are joined.
    """
    served = stage_holders(versions).select("model", F.coalesce("production", "staging").alias("number"))
    chosen = served.where(F.col("number").isNotNull()).join(
        versions.select("model", "number", "stage", "training_run_id"), ["model", "number"])
    run = runs.select(
        F.col("run_id").alias("training_run_id"), "flow", F.col("status").alias("run_status"),
        F.col("user").alias("run_user"), "start_time", "end_time", "commit")
    data = artifacts.where(F.col("step") == "load_data").select(
        F.col("run_id").alias("training_run_id"), "output", "uri")
    trace = chosen.join(run, "training_run_id", "left").join(data, "training_run_id", "left")
    if predictions is not None:
        counts = predictions.groupBy("model", "number").agg(F.count(F.lit(1)).alias("n_predictions"))
        trace = trace.join(counts, ["model", "number"], "left")
    return trace


def lineage_hops(links: DataFrame, node: str = "node", source: str = "source") -> DataFrame:
    """Follow import links to their origin over any number of hops: ``node, origin, hops, looped``.

    ``links`` has one row for each version and where it was imported from (null if it was trained here). In each round every
    version takes over the source of its source, so the number of rounds is the logarithm of the longest chain. What is open
    when no chain can be longer runs in a circle or into one: it has no origin. A source without a row of its own is
    an origin. A version with several sources is an error of the registry; the smallest counts.
    """
    one = links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(source).alias("source"))
    one = materialize(one, "links")
    # A version's place: where its walk stands, the hops so far, and whether that is an origin.
    inner = one.where(F.col("source").isNotNull())
    ends = inner.join(inner.select(F.col("node").alias("source"), F.lit(True).alias("goes_on")), "source", "left")
    state = materialize(ends.select("node", F.col("source").alias("at"), F.lit(1).cast("long").alias("hops"), F.col("goes_on").isNull().alias("done")), "hops")
    open_, reach = state.where("not done").count(), 1
    longest = open_
    while open_ and reach <= longest:
        step = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("done").alias("ends"))
        moved = state.where("not done").join(step, "at").select("node", F.col("next").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("ends").alias("done"))
        state = materialize(state.where("done").unionByName(moved), "hops")
        open_, reach = state.where("not done").count(), 2 * reach
    roots = one.where(F.col("source").isNull()).select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("done"))
    return state.unionByName(roots).select(
        "node", F.when(F.col("done"), F.col("at")).alias("origin"), F.when(F.col("done"), F.col("hops")).alias("hops"), (~F.col("done")).alias("looped"))


def run_metrics(runs: DataFrame, artifacts: DataFrame, output_metrics: DataFrame, versions: DataFrame,
                version_metrics: DataFrame) -> DataFrame:
    """Metrics of each run: from outputs named like metrics of steps named like evaluation, else from its version.

    ``output_metrics`` has (step_run_id, metric, value): the content of the outputs.
    """
    step, output = F.lower("step"), F.lower("output")
    measured = artifacts.where((step.contains("evaluate") | step.contains("metrics")) & output.contains("metrics"))
    # A run may have several such outputs; the one of the last step is taken.
    last = measured.groupBy("run_id").agg(F.max("step_run_id").alias("step_run_id"))
    direct = last.join(output_metrics, "step_run_id").select("run_id", "metric", "value", F.lit("output").alias("origin"))
    known = version_metrics.where(F.col("metric").isin(*P.METRICS))
    of_version = versions.where(F.col("training_run_id").isNotNull()).groupBy("training_run_id").agg(
        F.max(F.struct("model", "number")).alias("v")).select(
        F.col("training_run_id").alias("run_id"), F.col("v.model").alias("model"), F.col("v.number").alias("number"))
    fallback = (
        runs.select("run_id").join(last, "run_id", "left_anti").join(of_version, "run_id")
        .join(known, ["model", "number"]).select("run_id", "metric", "value", F.lit("version").alias("origin"))
    )
    return direct.unionByName(fallback)


def with_duration(steps: DataFrame) -> DataFrame:
    """Seconds from start to end; 0.0 if either is missing."""
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    return steps.withColumn("seconds", F.coalesce(seconds, F.lit(0.0)))


def step_durations(steps: DataFrame) -> DataFrame:
    """Per step: runs, failures, and the mean and extremes of the duration."""
    return with_duration(steps).groupBy("step").agg(
        F.count(F.lit(1)).alias("runs"),
        flag_sum(F.col("status") == "failed").alias("failures"),
        F.avg("seconds").alias("mean_seconds"),
        F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
    )


# Alert formats
STEP_OK = "✅ *Step Succeeded*\n• Pipeline: `{flow}`\n• Step: `{step}`\n• Run: `{run}`"
STEP_FAILED = "❌ *Step Failed*\n• Pipeline: `{flow}`\n• Step: `{step}`\n• Run: `{run}`\n• Error: `{error}`"
RUN_OK = "🎉 *Pipeline Completed Successfully*\n• Pipeline: `{flow}`\n• Run: `{run}`"
RUN_MODEL = "\n• Model: `{model}` v{number}"
RUN_FAILED = ("🚨 *Pipeline Failed*\n• Pipeline: `{flow}`\n• Run: `{run}`\n• Error: `{error}`"
              "\n• Action Required: Please investigate immediately")


def step_alerts(steps: DataFrame) -> DataFrame:
    """The message of every step; sending it is left to the caller."""
    from tollgate.functions.scalars import text_or_null
    parts = {"flow": F.col("flow"), "step": F.col("step"), "run": F.col("run_id"), "error": F.coalesce("error", F.lit(""))}
    message = F.when(F.col("status") == "failed", text_or_null(STEP_FAILED, **parts)).otherwise(text_or_null(STEP_OK, **parts))
    return steps.select("step_run_id", "run_id", "status", message.alias("message"))


def run_alerts(runs: DataFrame, steps: DataFrame, versions: DataFrame) -> DataFrame:
    """The message of every run: with its model if it succeeded, with its first error if it failed."""
    from tollgate.functions.scalars import text_or_null
    errors = steps.where(F.col("status") == "failed").groupBy("run_id").agg(
        F.min_by("error", F.struct("start_time", "step_run_id")).alias("error"))
    models = versions.where(F.col("training_run_id").isNotNull()).groupBy(
        F.col("training_run_id").alias("run_id")).agg(F.max(F.struct("model", "number")).alias("v"))
    joined = runs.join(errors, "run_id", "left").join(models, "run_id", "left")
    parts = {"flow": F.col("flow"), "run": F.col("run_id"), "error": F.coalesce("error", F.lit(""))}
    model = F.coalesce(text_or_null(RUN_MODEL, model=F.col("v.model"), number=F.col("v.number")), F.lit(""))
    message = F.when(F.col("status") == "failed", text_or_null(RUN_FAILED, **parts)).otherwise(
        F.concat(text_or_null(RUN_OK, **parts), model))
    return joined.select("run_id", "status", message.alias("message"))


def last_failed_run(runs: DataFrame, steps: DataFrame, by: str = "flow") -> DataFrame:
    """The latest failed run of each flow, with the steps that failed in it and their errors."""
    last = runs.where(F.col("status") == "failed").groupBy(by).agg(
        F.max_by("run_id", F.struct("start_time", "run_id")).alias("run_id"), F.max("start_time").alias("run_start"))
    failed = steps.where(F.col("status") == "failed").select("run_id", "step", "error", "step_run_id")
    return last.join(failed, "run_id")
