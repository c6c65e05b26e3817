"""Values at the edges: shares, infinities, gaps, several holders, typed metadata, stored bundles, work per scan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tollgate.operators import audit, drift, evaluate, features, manifests, models, quality, registry
from tollgate.sources import bundles


def test_sampled_log_keeps_none_and_all(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    assert audit.sampled_log(df, "k", 0.0).count() == 0 and audit.sampled_log(df, "k", 1.0).count() == 2000
    with pytest.raises(ValueError, match="between 0 and 1"):
        audit.sampled_log(df, "k", 1.5)


def test_infinite_scores_are_ranked(spark):
    rows = [(float("inf"), 1), (float("-inf"), 0), (0.1, 0), (0.2, 1), (0.3, 0), (float("inf"), 1), (float("-inf"), 0)] * 5
    df = spark.createDataFrame(rows, "probability double, label int")
    want = (2 * 4 + 1 * 3) / (3 * 4)
    assert evaluate.roc_auc(df, buckets=200).first().roc_auc == pytest.approx(want)
    both = df.withColumn("is_current", F.col("label") == 1)
    assert drift.numeric_drift(both, ["probability"], buckets=200).first().ks == pytest.approx(0.75)


def test_rows_without_a_prediction_count_nowhere(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1), (1, None, 0.8)], "label int, prediction int, probability double")
    one, two = evaluate.binary_metrics(df).first(), evaluate.evaluate(df).first()
    assert (one.n, one.accuracy) == (two.n, two.accuracy) == (2, 1.0)


def test_history_over_a_gap(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    events = spark.createDataFrame([("m", 1, s, "promoted", t, day(s + 1)) for s, t in ((0, "staging"), (2, "production"), (3, "archived"))],
                                   "model string, number int, seq int, action string, to_stage string, ts timestamp_ntz")
    rows = registry.stage_history(events).orderBy("seq").collect()
    assert [(r.previous_stage, r.days_in_stage, r.is_last) for r in rows] == [(None, 2, False), ("staging", 1, False), ("production", None, True)]


def versions_of(spark):
    rows = [("m", 1, "staging"), ("m", 2, "staging"), ("m", 3, None), ("m", 4, None)]
    return spark.createDataFrame([(*r, "staging", f"run{r[1]}") for r in rows],
                                 "model string, number int, stage string, environment string, training_run_id string")


def metrics_of(spark):
    values = {1: 0.9, 2: 0.9, 3: 0.9, 4: 0.5}
    return spark.createDataFrame([("m", n, k, v) for n, v in values.items() for k in ("accuracy", "precision", "recall")],
                                 "model string, number int, metric string, value double")


def no_events(spark):
    return spark.createDataFrame([], "model string, number int, seq int, ts timestamp_ntz")


@pytest.mark.parametrize("number,flags,decision,changed", [
    (3, {}, "blocked", set()), (3, {"force": True}, "promoted", {(1, "archived"), (2, "archived"), (3, "staging")}),
    (2, {"force": True}, "promoted", {(1, "archived"), (2, "staging")}), (4, {"force": True}, "refused", set()),
    (4, {"force": True, "skip_validation": True}, "promoted", {(1, "archived"), (2, "archived"), (4, "staging")}), (9, {}, "not found", set())])
def test_promotion_looks_at_gate_and_all_holders(spark, number, flags, decision, changed):
    wanted = spark.createDataFrame([("m", number, None)], "model string, version int, from_stage string")
    ts = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    decided, added = registry.promotion_flow(wanted, versions_of(spark), metrics_of(spark), no_events(spark), "staging", ts, **flags)
    assert decided.first().decision == decision
    assert {(r.number, r.to_stage) for r in added.collect()} == changed


def test_only_json_numbers_have_a_value(spark):
    raw = {"a": "0.5", "b": '"12d"', "c": '"NaN"', "d": '"0.85"', "e": '"[draft] note"', "f": '"null"', "g": "null", "h": "[1]", "i": "true",
           "j": '{"value": 3}', "k": '{"value": "3"}', "l": '{"other": 1}'}
    df = spark.createDataFrame([("m", 1, n, r) for n, r in raw.items()], "model string, number int, name string, raw string")
    got = {r.name: (r.text, r.value) for r in manifests.unwrap_metadata(df).collect()}
    assert got == {"a": ("0.5", 0.5), "b": ("12d", None), "c": ("NaN", None), "d": ("0.85", None), "e": ("[draft] note", None),
                   "f": ("null", None), "i": ("true", None), "j": ("3", 3.0), "k": ("3", None)}


def test_quality_takes_one_scan_and_one_narrow_exchange(spark):
    df = spark.createDataFrame([(i % 7, None if i % 5 else 1.0, "long text " * 20) for i in range(60)], "a int, b double, t string")
    row = quality.quality_measures(df, ["a", "b", "t"]).first()
    assert (row.n_rows, row.missing_cells) == (60, 48) and row.duplicate_rows == 60 - df.distinct().count()
    plan = quality.quality_measures(spark.read.parquet(saved(df)), ["a", "b", "t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "t#" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)
    empty = quality.quality_measures(df.limit(0), ["a", "b", "t"]).first()
    assert (empty.n_rows, empty.missing_cells, empty.duplicate_rows) == (0, 0, 0)


def saved(df):
    from tollgate.session import work_folder

    path = work_folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return path


def test_forest_bundle_with_components_scores_the_same_after_loading(spark):
    from tollgate.session import work_folder

    names = ["a", "b", "c"]
    rows = [(i, float(i % 11), float(i % 5), float((i * i) % 7), int(i % 11 > 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    scaler = features.fit_scaler(df, names)
    parts = features.fit_components(scaler.transform(df).withColumn("__x", F.array(*names)), "__x", 3, 2)
    reduced = parts.transform(scaler.transform(df).withColumn("__x", F.array(*names)), "__x", ["id", "label"])
    forest = models.fit_forest(reduced, "id", ["PC1", "PC2"], n_estimators=5, max_depth=4)
    bundle = bundles.Bundle(tuple(names), forest, scaler, parts)
    loaded = bundles.load_bundle(spark, bundles.save_bundle(bundle, spark, work_folder(spark, "bundle")))
    want = models.forest_scores(forest, reduced, ["id"]).orderBy("id").collect()
    assert loaded.score(df, ["id"]).orderBy("id").collect() == want
    assert loaded.score(df, ["id", "a"]).columns == ["id", "a", "prediction", "probability"]


def test_stages_resolve_to_bundles(spark):
    versions = spark.createDataFrame([("m", 1, "staging", "one"), ("m", 2, None, "two")], "model string, number int, stage string, bundle string")
    assert bundles.resolve(versions, "m", "staging") == (1, "one")
    assert bundles.resolve(versions, "m", "production", fall_back=True) == (2, "two")
    for model in ("m", "none"):
        with pytest.raises(bundles.NoVersionError):
            bundles.resolve(versions, model, "production")
    row = bundles.new_version(versions, "m", "three", "local", F.lit("2024-01-01").cast("timestamp"), "run").first()
    assert (row.number, row.stage, row.bundle) == (3, None, "three")


def test_a_runs_cut_points_go_with_it(spark):
    import os

    from tollgate.session import run_folder
    from tollgate.sources.artifacts import materialize

    with run_folder(spark) as path:
        kept = materialize(spark.range(10), "numbers").count()
        assert kept == 10 and len(os.listdir(path.removeprefix("file:"))) == 1
    assert not os.path.exists(path.removeprefix("file:"))
