"""Queries that run a whole course of events: a log that is appended to, a release, a stream with a promotion in between."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from checks.catalog import (
    FEATURES, KEY, _audit_log, _closed_form, _drift_pair, _labelled_requests, _requests, _split_table, _versions, query, tidy)
from tollgate import params as P
from tollgate.functions.scalars import key_hash
from tollgate.operators import as_of, audit, balance, drift, evaluate, forest, lineage, models, quality, registry
from tollgate.plans import release, training
from tollgate.session import work_folder
from tollgate.sources import artifacts as store
from tollgate.sources import bundles
from tollgate.sources import registry_tables as reg
from tollgate.sources import requests as req
from tollgate.sources import tables as src
from tollgate.sources.registry_log import RegistryLog, StaleEntriesError
from tollgate.streaming import monitor
from tollgate.streaming import scoring as stream_scoring


def at(day: str):
    return F.lit(f"2024-06-{day} 00:00:00").cast("timestamp_ntz")


# --- The forest as a table --------------------------------------------------------------------------------------------

def _stump(spark, folder):
    """One tree of one cut on the number of lines, from all train rows as they are."""
    table = _split_table(spark, folder)
    fitted = models.fit_forest(table.where("split = 'train'"), KEY, ["n_lines"], n_estimators=1, max_depth=1, bootstrap=False)
    return table, store.materialize(forest.forest_nodes(fitted, table, ["n_lines"]), "nodes")


@query("forest_stump_nodes")
def forest_stump_nodes(spark, folder):
    return tidy(_stump(spark, folder)[1])


@query("forest_stump_score")
def forest_stump_score(spark, folder):
    table, nodes = _stump(spark, folder)
    return tidy(forest.score_nodes(table.where("split = 'test'"), nodes, [KEY]))


@query("forest_nodes_score")
def forest_nodes_score(spark, folder):
    """A forest of the staging size scored from its table of nodes, beside the scores of the library that trained it."""
    table, params = _split_table(spark, folder), P.ENVIRONMENTS["staging"]
    fitted = models.fit_forest(table.where("split = 'train'"), KEY, FEATURES, n_estimators=params.n_estimators, max_depth=params.max_depth)
    nodes = store.materialize(forest.forest_nodes(fitted, table, FEATURES), "nodes")
    test = table.where("split = 'test'")
    mine = forest.score_nodes(test, nodes, [KEY])
    theirs = models.forest_scores(fitted, test, [KEY]).select(KEY, F.col("prediction").alias("class"), F.col("probability").alias("p"))
    trees = nodes.agg(F.count_distinct("tree").alias("trees"))
    found = mine.join(theirs, KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") != F.col("class")).alias("other_class"),
        (F.max(F.abs(F.col("probability") - F.col("p"))) < 1e-12).alias("equal_scores"))
    return found.crossJoin(trees)  # one row each


# --- The registry, stored ---------------------------------------------------------------------------------------------

@query("promotion_append")
def promotion_append(spark, folder):
    """The log holds the chains; the newest measured version of each model is promoted, twice over; then a writer that still has the
    old state comes. What is read back, and whether that writer was refused."""
    versions = _versions(spark, folder)
    events = store.materialize(reg.promotion_events(spark, folder, versions), "events")
    log = RegistryLog(spark, work_folder(spark, "registry-log"), events.schema)
    log.append(events, "history")
    best = store.materialize(
        registry.latest_with_metrics(versions, reg.version_metrics(spark, folder)).select("model", "number"), "best")
    added = registry.promote(best, versions, log.entries(), "staging", at("01"))
    stored = [log.append(added, "staging_best") for _ in range(2)]
    try:
        log.append(registry.promote(best, versions, events, "production", at("02")), "production_best")
        refused = False
    except StaleEntriesError:
        refused = True
    state = registry.current_stage(log.entries()).drop("since")
    n = log.entries().groupBy("model", "number").agg(F.count(F.lit(1)).cast("int").alias("entries"))
    return state.join(n, ["model", "number"]).withColumns(
        {"stored_once": F.lit(stored == [True, False]), "refused": F.lit(refused)})


@query("train_register_score")
def train_register_score(spark, folder):
    """A closed-form version serves; a training run with components becomes the next version, passes the gate, is promoted
    and serves; it is rolled back. Each time all orders are scored by the stage."""
    table = store.materialize(src.large_order(spark, folder), "labelled")
    name = "breast_cancer_orders"
    empty = release.Registry(spark.createDataFrame([], release.VERSIONS), spark.createDataFrame([], release.METRICS),
                             RegistryLog(spark, work_folder(spark, "registry-log"), release.ENTRIES))
    scored, model = _closed_form(spark, folder)
    measured = evaluate.evaluate(bundles.Bundle(tuple(FEATURES), model).score(scored.where("split = 'test'"), [KEY, "label"]))
    state, first = release.register(empty, name, bundles.Bundle(tuple(FEATURES), model), measured, "staging", at("01"), "run-1")
    promote = lambda number, day, **how: release.promote_version(state, name, number, "production", at(day), **how)
    # The gate asks for more than these features give; a person may waive it.
    decisions = [release.promote_version(state, name, first, "staging", at("02")), promote(first, "02"), promote(first, "02", skip_validation=True)]
    served = lambda step: bundles.score_stage(table, state.staged(), name, "production", [KEY]).select(
        KEY, F.lit(step).alias("step"), "model_stage", "model_version", F.col("probability").between(0, 1).alias("scored"))
    parts = [store.materialize(served("first"), "served")]

    params = replace(P.ENVIRONMENTS["staging"], enable_pca=True, max_features_for_pca=len(FEATURES) - 1, n_estimators=5,
                     enable_resampling=False, enable_governance=False)
    run = training.training_flow(table, KEY, FEATURES, params)
    state, second = release.register_run(state, name, run, FEATURES, at("03"), "run-2")
    decisions += [promote(second, "04", skip_validation=True), promote(second, "05", skip_validation=True, force=True)]
    parts.append(store.materialize(served("released"), "served"))
    release.roll_back(state, at("06"), "drift")
    parts.append(store.materialize(served("rolled back"), "served"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("decisions", F.lit(", ".join(decisions)))


# --- A stream served by stage -----------------------------------------------------------------------------------------

@query("stream_score_stage")
def stream_score_stage(spark, folder):
    """Even events arrive, the other version is promoted, odd events arrive; the body of every third is broken. Answers and
    rejects, each written by the batch that read them."""
    fields = list(P.REQUEST_DEFAULTS)
    requests = store.materialize(_requests(spark, folder), "made")
    labelled = _labelled_requests(requests)
    first = models.fit_gaussian(labelled, fields)
    second = models.fit_gaussian(stream_scoring.valid_requests(labelled.where("event_id % 2 = 1")), fields)
    paths = [bundles.save_bundle(bundles.Bundle(tuple(fields), m), spark, work_folder(spark, "bundle")) for m in (first, second)]
    versions = spark.createDataFrame(
        [("requests", 1, "staging", paths[0]), ("requests", 2, None, paths[1])], "model string, number int, stage string, bundle string")
    log = RegistryLog(spark, work_folder(spark, "registry-log"), release.ENTRIES)
    state = release.Registry(
        versions.select("model", "number", F.lit(None).cast("string").alias("stage"), F.lit("staging").alias("environment"), "bundle",
                        F.lit(None).cast("string").alias("training_run_id"), at("01").alias("created")),
        versions.select("model", "number", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(0.9).alias("value")) for m in P.METRICS]))
                        .alias("m")).select("model", "number", "m.metric", "m.value"), log)

    broken = F.element_at(F.array(F.lit("not json"), F.lit('{"mean_radius": null}'), F.lit(None).cast("string")), (F.col("event_id") % 9 / 3 + 1).cast("int"))
    bodies = requests.withColumn("body", F.when(F.col("event_id") % 3 == 0, broken).otherwise(F.col("body")))
    source, output, rejects, checkpoint = (work_folder(spark, n) for n in ("arrived", "answers", "rejects", "state"))
    for number in (1, 2):
        release.promote_version(state, "requests", number, "production", at(f"0{number + 1}"), force=True)
        bodies.where(F.col("event_id") % 2 == number - 1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(bodies.schema).parquet(source)
        stream_scoring.start_stage_scoring(stream, state.staged, "requests", "production", output, rejects, checkpoint).awaitTermination()
    answered = spark.read.parquet(output).select("event_id", "prediction", "probability", "risk_level", "model_version", F.lit(None).cast("string").alias("problem"))
    refused = spark.read.parquet(rejects).select("event_id", "problem")
    return tidy(answered.unionByName(refused, allowMissingColumns=True))


# --- Neighbours by hashing --------------------------------------------------------------------------------------------

@query("smote_hashed")
def smote_hashed(spark, folder):
    """Vectors of 64 columns, balanced by hashed neighbours: rows per class, and whether the new ones lie within their class."""
    names = [f"e{i}" for i in range(64)]
    label = F.when(F.col("label") < 6, 0).when(F.col("label") < 9, 1).otherwise(2).alias("label")
    table = store.materialize(src.table(spark, folder, "embeddings").select(
        "vec_id", label, *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), "wide")
    made = store.materialize(balance.smote(table, "vec_id", names, hashed=True), "balanced")
    edges = table.groupBy("label").agg(*[e for n in names for e in (F.min(n).alias(f"{n}_low"), F.max(n).alias(f"{n}_high"))])
    inside = reduce(lambda a, b: a & b, [F.col(n).between(F.col(f"{n}_low") - 1e-9, F.col(f"{n}_high") + 1e-9) for n in names])
    return made.join(edges, "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("n_synthetic"), F.count_distinct("vec_id").alias("n_keys"),
        F.bool_and(inside).alias("inside"))


# --- As of, over hops, in parts ---------------------------------------------------------------------------------------

@query("scored_by_version")
def scored_by_version(spark, folder):
    """The version in production when each order was scored; half of all orders are scored by one model."""
    events = store.materialize(reg.promotion_events(spark, folder), "events")
    scored = reg.scored_orders(spark, folder).select(
        KEY, F.when(key_hash(KEY, "hot") < "80", "breast_cancer_0").otherwise(F.col("model")).alias("model"), F.col("o_orderdate").alias("ts"))
    return as_of.as_of(scored, as_of.production_changes(events), ["model"], "ts", "at", ["production"]).drop("ts")


@query("lineage_hops")
def lineage_hops(spark, folder):
    """Two of three versions were imported from a lower number of another model or their own; some run in a circle."""
    versions = _versions(spark, folder)
    name = lambda m, n: F.concat(m, F.lit("/"), n.cast("string"))
    h = key_hash(name(F.col("model"), F.col("number")), "import")
    source = (
        F.when(h < "08", name(F.col("model"), F.col("number")))
        .when(h < "18", name(F.col("model"), F.col("number") + 1))
        .when(h < "a8", name(F.col("model"), F.col("number") - 1)))
    links = versions.select(name(F.col("model"), F.col("number")).alias("node"), source.alias("source"))
    return lineage.lineage_hops(links)


@query("drift_from_profile")
def drift_from_profile(spark, folder):
    """The reference's profile is stored; the current half comes in two parts, whose profiles are merged."""
    _, shifted = _drift_pair(spark, folder)
    kept = shifted.where("NOT is_current")
    profile = drift.reference_profile(kept, ["value", "hour"], ["event_type"])
    path = store.write_table(profile, work_folder(spark, "profile"))
    stored = spark.read.parquet(path)
    parts = [drift.fold_profile(shifted.where(F.col("is_current") & (F.col("hour") % 2 == i)), stored, ["event_type"]) for i in (0, 1)]
    return tidy(drift.drift_from_profile(stored, drift.merge_profiles(*parts)))


@query("retention_apply")
def retention_apply(spark, folder):
    """The log as it is on storage after removal, and again after a second one."""
    path = store.write_table(_audit_log(spark, folder), work_folder(spark, "audit"), ("month",))
    audit.apply_retention(spark, path, "2024-04-10")
    audit.apply_retention(spark, path, "2024-04-10")
    return tidy(spark.read.parquet(path).drop("month"))


@query("retention_dry_run")
def retention_dry_run(spark, folder):
    path = store.write_table(_audit_log(spark, folder), work_folder(spark, "audit"), ("month",))
    return tidy(audit.retention_plan(spark.read.parquet(path), "2024-04-10"))


@query("dq_incremental")
def dq_incremental(spark, folder):
    """The gate from the stored states of three parts of a table, whose copies lie in different parts."""
    table = src.dirty_lineitem(spark, folder)
    path = work_folder(spark, "states")
    parts = store.materialize(table.withColumn("__part", F.monotonically_increasing_id() % 3), "parts")
    for i in range(3):
        quality.quality_state(parts.where(F.col("__part") == i), table.columns).write.mode("append").parquet(path)
    return tidy(quality.quality_verdict(quality.merged_measures(spark.read.parquet(path), len(table.columns))))


@query("comparison_pair_of_run")
def comparison_pair_of_run(spark, folder):
    """As ``comparison_pair``, in a run that has a version of every other model."""
    versions = _versions(spark, folder)
    own = versions.where(key_hash("model", "run") < "80").groupBy("model").agg(F.min("number").alias("number"))
    return registry.comparison_pair(versions.withColumn("stage", F.when(key_hash("model", "empty") < "80", None).otherwise(F.col("stage"))), own)


@query("retrain_trigger_all_columns")
def retrain_trigger_all_columns(spark, folder):
    _, shifted = _drift_pair(spark, folder)
    columns = drift.drift_columns(shifted, ["value", "hour"], ["event_type"])
    return tidy(drift.retrain_trigger(drift.drift_score(columns)))


@query("stream_monitor_late")
def stream_monitor_late(spark, folder):
    """The last file brings rows two days after their time: the watermark has passed them and they are dropped."""
    events, source = req.read_events(spark, folder), work_folder(spark, "events")
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    events.where(~late).write.mode("append").parquet(source)
    output, state = work_folder(spark, "windows"), work_folder(spark, "state")

    def run():
        scores = req.stream_events(spark, source, "*.parquet").select(
            F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).cast("int").alias("prediction"),
            (F.col("value") / (F.col("value") + 50)).alias("probability"))
        monitor.start_monitor(monitor.window_summary(scores), output, state).awaitTermination()

    run()
    events.where(late).write.mode("append").parquet(source)
    run()
    events.limit(0).unionByName(monitor.closing_rows(events), allowMissingColumns=True).write.mode("append").parquet(source)
    run()
    return tidy(spark.read.parquet(output))
