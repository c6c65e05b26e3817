"""Lookup, stages, chain, rollback, manifests, lineage and audit on small registries."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.operators import audit, lineage, manifests, registry
from tollgate.sources import artifacts

DAY = dt.datetime(2024, 1, 1)
VERSIONS = "model string, number int, version_id string, stage string, environment string, created timestamp_ntz, updated timestamp_ntz, training_run_id string, has_scaler boolean"


def versions_of(spark, rows):
    """rows: (model, number, stage, environment)"""
    return spark.createDataFrame(
        [(m, n, f"id-{m}-{n}", s, e, DAY, DAY + dt.timedelta(days=n), f"run-{n}" if n % 2 else None, n % 2 == 0) for m, n, s, e in rows], VERSIONS)


def measured(spark, rows):
    """rows: (model, number, metrics present)"""
    return spark.createDataFrame([(m, n, x, 0.9) for m, n, names in rows for x in names],
                                 "model string, number int, metric string, value double")


ALL = ("accuracy", "precision", "recall")


@pytest.fixture(scope="module")
def small(spark):
    versions = versions_of(spark, [
        ("a", 1, "archived", "local"), ("a", 2, None, "staging"), ("a", 4, "production", "staging"), ("a", 5, "staging", "local"), ("a", 6, None, None),
        ("b", 1, None, "local"), ("b", 2, None, "local"), ("c", 3, "production", None)])
    metrics = measured(spark, [("a", 1, ALL), ("a", 2, ALL), ("a", 4, ALL[:2]), ("a", 5, ALL), ("b", 1, ALL), ("b", 2, ALL[1:])])
    return versions, metrics


def by_model(df, *names):
    return {r.model: tuple(r[n] for n in names) for r in df.collect()}


def test_latest_with_metrics(small):
    got = by_model(registry.latest_with_metrics(*small), "number", "fallback")
    assert got == {"a": (2, False), "b": (1, True)}
    assert by_model(registry.latest_with_metrics(*small, prefer=None), "number")["a"] == (5,)


def test_latest_with_metrics_sees_more_than_one_page(spark):
    versions = versions_of(spark, [("m", n, None, "local") for n in range(1, 41)])
    metrics = measured(spark, [("m", 1, ALL)] + [("m", n, ALL[:1]) for n in range(2, 41)])
    assert by_model(registry.latest_with_metrics(versions, metrics), "number") == {"m": (1,)}


def test_lookup_order(spark, small):
    wanted = spark.createDataFrame([("a", 4, "staging"), ("a", 99, None), ("a", None, "latest"), ("a", None, "production"), ("a", None, None),
                                    ("b", None, "staging"), ("c", None, None)], "model string, version int, from_stage string")
    got = {(r.model, r.version, r.from_stage): (r.chosen_by, r.number, r.found) for r in registry.look_up(wanted, *small).collect()}
    assert got == {
        ("a", 4, "staging"): ("version", 4, True), ("a", 99, None): ("version", None, False), ("a", None, "latest"): ("stage", 6, True),
        ("a", None, "production"): ("stage", 4, True), ("a", None, None): ("metrics", 2, True), ("b", None, "staging"): ("stage", None, False),
        ("c", None, None): ("metrics", None, False)}


def test_champion_and_challenger_fall_back_to_the_newest(small):
    assert by_model(registry.comparison_pair(small[0]), "champion", "challenger") == {"a": (5, 4), "b": (2, 2), "c": (3, 3)}


def test_occupancy(small):
    versions = small[0]
    picked = versions.where("(model = 'a' and number in (2, 5)) or (model = 'b' and number = 1)")
    got = {(r.model, r.number): (r.occupant, r.outcome) for r in registry.occupancy(picked, versions, "staging").collect()}
    assert got == {("a", 2): (5, "blocked"), ("a", 5): (None, "free"), ("b", 1): (None, "free")}
    assert {r.outcome for r in registry.occupancy(picked, versions, "staging", force=True).collect()} == {"demote", "free"}
    assert {r.outcome for r in registry.occupancy(picked, versions, "archived").collect()} == {"free"}


EVENTS = "model string, number int, seq int, action string, workspace string, from_stage string, to_stage string, ts timestamp_ntz, training_run_url string"


def events_of(spark):
    return spark.createDataFrame([
        ("a", 5, 0, "promoted", "w", "none", "staging", DAY, None), ("a", 4, 0, "promoted", "w", "none", "staging", DAY, None),
        ("a", 4, 1, "promoted", "w", "staging", "production", DAY + dt.timedelta(days=7), None)], EVENTS)


def test_forced_promotion_leaves_one_holder(spark, small):
    versions, events = small[0], events_of(spark)
    chosen = versions.where("model = 'a' and number = 2").select("model", "number")
    ts = F.lit("2024-02-01").cast("timestamp_ntz")
    added = registry.promote(chosen, versions, events, "staging", ts)
    stages = {r.number: (r.stage, r.seq) for r in registry.current_stage(events.unionByName(added)).collect()}
    assert stages == {2: ("staging", 0), 5: ("archived", 1), 4: ("production", 1)}
    assert registry.promote(chosen, versions, events, "staging", ts, force=False).count() == 0
    before = {(r.number, r.to_stage): r.from_stage for r in added.collect()}
    assert before == {(2, "staging"): "none", (5, "archived"): "staging"}


def test_history(spark):
    got = {(r.number, r.seq): (r.previous_stage, r.stage, r.days_in_stage, r.is_last) for r in registry.stage_history(events_of(spark)).collect()}
    assert got == {(5, 0): (None, "staging", None, True), (4, 0): (None, "staging", 7, False), (4, 1): ("staging", "production", None, True)}
    chain = {r.number: [e.to_stage for e in r.chain] for r in registry.chains(events_of(spark)).collect()}
    assert chain == {5: ["staging"], 4: ["staging", "production"]}


def test_rollback_targets(spark, small):
    # Version 3 of model a is gone, so only an archived one below may be taken, although 2 is the previous version.
    assert by_model(registry.rollback_targets(small[0]), "current", "target", "previous") == {
        "a": (4, 1, 2), "b": (None, None, None), "c": (3, None, None)}
    direct = versions_of(spark, [("d", 1, "archived", None), ("d", 2, None, None), ("d", 3, "production", None)])
    assert by_model(registry.rollback_targets(direct), "target") == {"d": (2,)}


def test_rollback_plan_and_events(spark, small):
    versions, events = small[0], events_of(spark)
    plan = registry.rollback_plan(versions)
    assert by_model(plan, "outcome", "from_version", "to_version", "reason") == {
        "a": ("planned", 4, 1, "Not specified"), "b": ("no production version", None, None, "Not specified"),
        "c": ("no target version", 3, None, "Not specified")}
    same = registry.rollback_plan(versions, to_version=4, reason="bad")
    assert by_model(same, "outcome", "reason")["a"] == ("target is in production", "bad")
    assert by_model(registry.rollback_plan(versions, to_version=0), "outcome")["a"] == ("no target version",)
    rows = registry.rollback_events(plan, versions, events, F.lit("2024-02-01").cast("timestamp_ntz")).collect()
    assert {(r.number, r.seq, r.from_stage, r.to_stage) for r in rows} == {(1, 0, "archived", "production"), (4, 2, "production", "archived")}


def exported(spark, small):
    return manifests.export_manifests(*small, events_of(spark), "exchange", "2024-06-01T12:00:00")


def test_manifest_round_trip_and_import(spark, small, tmp_path):
    raw = manifests.manifest_json(exported(spark, small))
    path = artifacts.write_manifests(raw, str(tmp_path / "m"))
    back = {(r.model_name, r.source.model_version): r for r in artifacts.read_manifests(spark, path).collect()}
    r = back["a", 4]
    assert [e.action for e in r.promotion_chain] == ["promoted", "promoted", "exported"]
    assert r.metrics == {"accuracy": 0.9, "precision": 0.9} and r.source.training_run_url is None
    assert r.artifacts.scaler.endswith("/scaler") and back["a", 1].artifacts.scaler is None
    assert back["a", 1].source.training_run_url.endswith("/runs/run-1?tab=overview")
    assert {r.valid for r in manifests.validate_manifests(raw).collect()} == {True}
    parsed = raw.select("model", "number", artifacts.parse_manifest().alias("parsed"))
    run = F.when(F.col("number") == 4, F.lit("imp"))
    records = {(r.model, r.source_version): r for r in manifests.import_manifests(
        parsed, P.PRODUCTION_WORKSPACE, "production", "2024-06-01T13:00:00", run).collect()}
    last = records["a", 4].promotion_chain[-1]
    assert (last.action, last.to_workspace) == ("imported", P.PRODUCTION_WORKSPACE) and "/runs/imp?" in last.import_run_url
    assert records["a", 4].promotion_chain[0].import_run_url is None
    assert records["a", 1].promotion_chain[-1].import_run_url is None


@pytest.mark.parametrize("change, problem", [
    (lambda m: m.pop("source"), "missing required fields: source"),
    (lambda m: [m.pop("source"), m.pop("model_name")], "missing required fields: model_name, source"),
    (lambda m: m["source"].pop("workspace"), "missing source fields: workspace"),
    (lambda m: m["artifacts"].pop("model"), "missing artifacts.model field"),
    (lambda m: m.update(export_path=None), None)])
def test_manifest_validation(spark, small, change, problem):
    manifest = json.loads(manifests.manifest_json(exported(spark, small)).where("model = 'a' and number = 4").first().manifest)
    change(manifest)
    df = spark.createDataFrame([(json.dumps(manifest),)], "manifest string")
    row = manifests.validate_manifests(df).first()
    assert (row.valid, row.problem) == (problem is None, problem)


def test_back_links_only_for_exported_versions(spark, small):
    versions = small[0]
    arrived = spark.createDataFrame([("a", 4, "new-4"), ("a", 5, "new-5")], "model string, source_version int, new_version_id string")
    rows = manifests.back_links(versions.where("number = 4"), arrived, "w2", "production", "now").collect()
    assert [(r.number, r.promoted_to.model_version_id) for r in rows] == [(4, "new-4")]


def test_metadata_unwrap(spark):
    chain = '[{"action":"promoted","from_stage":"none","to_stage":"staging"}]'
    df = spark.createDataFrame([
        ("m", 1, "accuracy", "0.5"), ("m", 1, "recall", '{"value": 0.25}'), ("m", 1, "env", '"stag\\"ing"'), ("m", 1, "ok", "true"),
        ("m", 1, "list", "[1]"), ("m", 1, "nested", '{"value": [1]}'), ("m", 1, "none", "null"),
        ("m", 1, "promotion_chain", chain), ("m", 2, "promotion_chain", json.dumps(chain))], "model string, number int, name string, raw string")
    got = {r.name: (r.text, r.value) for r in manifests.unwrap_metadata(df).collect()}
    assert got == {"accuracy": ("0.5", 0.5), "recall": ("0.25", 0.25), "env": ('stag"ing', None), "ok": ("true", None)}
    assert [[e.to_stage for e in r.chain] for r in manifests.unwrap_chains(df).collect()] == [["staging"]] * 2


def test_lineage_shows_missing_links_as_null(spark, small):
    runs = spark.createDataFrame([("run-3", "training", "u", DAY, DAY, 1, "completed", "sha")],
                                 "run_id string, flow string, user string, start_time timestamp_ntz, end_time timestamp_ntz, n_steps int, status string, commit string")
    outputs = spark.createDataFrame([("run-3", "load_data", 1, "X_train", "u1"), ("run-3", "train", 2, "model", "u2")],
                                    "run_id string, step string, step_run_id int, output string, uri string")
    got = {r.model: (r.number, r.run_status, r.output, r.commit) for r in lineage.lineage_trace(small[0], runs, outputs).collect()}
    assert got == {"a": (4, None, None, None), "c": (3, "completed", "X_train", "sha")}


def test_durations(spark):
    steps = spark.createDataFrame([("s", "failed", DAY, DAY + dt.timedelta(seconds=2.5)), ("s", "completed", DAY, None)],
                                  "step string, status string, start_time timestamp_ntz, end_time timestamp_ntz")
    row = lineage.step_durations(steps).first()
    assert (row.runs, row.failures, row.min_seconds, row.max_seconds) == (2, 1, 0.0, 2.5)


def test_keep_last_runs_limits_before_the_shuffle(spark):
    flow = F.when(F.col("id") % 10 == 0, "rare").otherwise("hot")
    runs = spark.range(2000).select(flow.alias("flow"), F.col("id").cast("string").alias("run_id"), F.col("id").alias("start_time"))
    kept = audit.keep_last_runs(runs, 100)
    by_flow = {f: {int(r.run_id) for r in kept.where(F.col("flow") == f).collect()} for f in ("hot", "rare")}
    assert by_flow["rare"] == set(range(1000, 2000, 10))
    assert by_flow["hot"] == set(sorted((i for i in range(2000) if i % 10), reverse=True)[:100])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")


def test_approvals_count_distinct_allowed_people(spark):
    rows = [("m", 1, "ann", "ml-engineer")] * 3 + [("m", 1, "bob", "data-scientist"), ("m", 2, "ann", "ml-engineer"), ("m", 2, "cy", "platform-admin")]
    df = spark.createDataFrame(rows, "model string, number int, approver string, role string")
    assert {r.number: r.approved for r in audit.approval_gate(df, "production").collect()} == {1: False, 2: True}
    assert {r.approved for r in audit.approval_gate(df, "staging").collect()} == {True}


def test_retention_and_export_prune_by_month(spark, tmp_path):
    promotions = events_of(spark)
    runs = spark.createDataFrame([("r", "training", "failed", DAY - dt.timedelta(days=100))], "run_id string, flow string, status string, start_time timestamp_ntz")
    log = spark.read.parquet(artifacts.write_table(audit.audit_log(promotions, runs), str(tmp_path / "log"), ("month",)))
    assert log.count() == 4
    assert audit.retained(log, "2024-01-10").count() == 3
    assert audit.retained(log, "2024-01-10", "enterprise").count() == 4
    found = audit.audit_export(log, "2024-01-01", "2024-01-01", ["model_promotion"], P.PROJECT)
    assert found.count() == 2 and "month" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
