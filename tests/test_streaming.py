"""Streams equal their batch twins, drop late rows, and go on from their checkpoint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tollgate.operators import models
from tollgate.sources import requests as req
from tollgate.streaming import monitor, scoring
from tollgate import params as P


@pytest.fixture(scope="module")
def model(spark, folder):
    parsed = req.parse_requests(req.request_bodies(req.read_events(spark, folder)))
    return models.fit_gaussian(parsed.withColumn("label", (F.col("mean_radius") < 14).cast("int")), list(P.REQUEST_DEFAULTS))


def test_defaults_fixed_order_and_unknown_names(spark):
    df = spark.createDataFrame([(1, '{"mean_radius": 20.5, "age": 72, "num_inpatient": 3}'), (2, "{}"), (3, '{"worst_area": "881.5"}')], "event_id long, body string")
    rows = {r.event_id: r for r in req.parse_requests(df).collect()}
    assert rows[1].mean_radius == 20.5 and rows[1].mean_texture == 19.0 and list(rows[1].unknown_fields) == ["age", "num_inpatient"]
    assert [rows[2][n] for n in P.REQUEST_DEFAULTS] == list(P.REQUEST_DEFAULTS.values()) and len(P.REQUEST_DEFAULTS) == 30
    assert rows[3].worst_area == 881.5 and all(r.valid for r in rows.values())


def test_invalid_requests_are_rejected_and_never_scored(spark, model):
    bodies = ["not json", '{"mean_radius":', '{"mean_radius": "abc"}', '{"mean_radius": null}', "[1]", None, "7", '{"mean_radius": {"a": 1}}',
              '{"mean_radius": 1, "mean_radius": 2}', '{"mean_radius": 3}']
    df = spark.createDataFrame(list(enumerate(bodies)), "event_id long, body string")
    parsed = req.parse_requests(df)
    rows = {r.event_id: r for r in parsed.collect()}
    assert [rows[i].valid for i in range(10)] == [False] * 9 + [True]
    assert all(rows[i].mean_radius is None and rows[i].problem for i in range(9))
    assert {r.event_id for r in req.rejected_requests(parsed).collect()} == set(range(9))
    assert [r.event_id for r in scoring.score_requests(df, model, 1).collect()] == [9]


def test_stream_scores_equal_batch_scores_and_follow_a_promotion(spark, folder, model, tmp_path):
    events = req.read_events(spark, folder)
    source, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    version = {"number": 1}

    def run():
        stream = req.request_bodies(req.stream_events(spark, source, "*.parquet"))
        scoring.start_scoring(stream, lambda: (model, version["number"]), output, state).awaitTermination()

    events.where("event_id % 2 = 0").write.mode("append").parquet(source)
    run()
    version["number"] = 2
    events.where("event_id % 2 = 1").write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(output).drop("batch")
    batch = scoring.score_requests(req.request_bodies(events), model, 1)
    plain = lambda df: sorted((r.event_id, r.prediction, r.probability, r.risk_level, tuple(r.explanation.top_risk_factors)) for r in df.collect())
    assert plain(got) == plain(batch)
    assert {(r.event_id % 2, r.model_version) for r in got.collect()} == {(0, "1"), (1, "2")}


def test_scoring_without_a_production_version_fails(spark, folder, tmp_path):
    stream = req.request_bodies(req.stream_events(spark, folder))
    with pytest.raises(Exception, match="no production version"):
        scoring.start_scoring(stream, lambda: None, str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()


def test_monitor_drops_late_rows_and_resumes(spark, tmp_path):
    source, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    start = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

    def add(minutes):
        rows = [(i, start + dt.timedelta(minutes=m), 1, "x", 0.8 if m % 2 else 0.2, None) for i, m in enumerate(minutes)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        scores = req.stream_events(spark, source, "*.parquet").select(
            F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 0.5).cast("int").alias("prediction"), F.col("value").alias("probability"))
        monitor.start_monitor(monitor.window_summary(scores), output, state).awaitTermination()

    add([1, 2, 3, 65, 200])
    add([5, 195, 300])  # minute 5 is hours late, minute 195 is within the watermark
    add([400])
    rows = {r.window_start.hour: (r.n, round(r.positive_rate, 6), round(r.mean_probability, 6)) for r in spark.read.parquet(output).collect()}
    assert rows == {0: (3, round(2 / 3, 6), 0.6), 1: (1, 1.0, 0.8), 3: (2, 0.5, 0.5), 5: (1, 0.0, 0.2)}


def test_bodies_of_one_row_group_are_made_by_many_tasks(spark, folder):
    bodies = req.request_bodies(req.read_events(spark, folder))
    assert bodies.rdd.getNumPartitions() == req.PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    rows = req.request_bodies(spark.createDataFrame([(None, None), (7, None), (7, None)], "event_id long, ts timestamp_ntz")).collect()
    assert sorted(r.event_id is None for r in rows) == [False, False, True]
    assert {r.body for r in rows if r.event_id is None} == {"{}"} and len({r.body for r in rows}) == 2


def test_odd_bodies(spark):
    bodies = ['{"mean_radius": 1.25, "mean_area": 3}', '{"mean_radius": "1.25"}', '{"mean_radius": 1, "mean_radius": 2}', '{"mean_radius": 1, "age": 3}',
              '{"mean_radius": true}', '{"mean_radius": "NaN"}', "{}", "", None, '{"mean_area": 12345678901234567890}']
    df = spark.createDataFrame(list(enumerate(bodies)), "event_id long, body string")
    found = [(r.mean_radius, r.mean_area, r.unknown_fields, r.problem) for r in req.parse_requests(df).orderBy("event_id").collect()]
    radius, area = P.REQUEST_DEFAULTS["mean_radius"], P.REQUEST_DEFAULTS["mean_area"]
    assert found[:5] == [(1.25, 3.0, [], None), (1.25, area, [], None), (None, None, [], "a name is given twice"), (1.0, area, ["age"], None),
                         (None, None, [], "not a number: mean_radius")]
    assert found[5][0] != found[5][0] and found[5][3] is None
    assert found[6] == (radius, area, [], None)
    assert [f[3] for f in found[7:9]] == ["body is not a JSON object"] * 2
    assert found[9] == (radius, 12345678901234567890.0, [], None)


def test_a_wide_score_is_the_same_number_outside_fused_code(spark, folder, model, monkeypatch):
    parsed = req.valid_requests(req.parse_requests(req.request_bodies(req.read_events(spark, folder))))
    z = lambda: {r.event_id: r.z for r in parsed.select("event_id", model.log_odds().alias("z")).collect()}
    wide = z()
    assert "aggregate(" in parsed.select(model.log_odds().alias("z"))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(models, "WIDE", 10 ** 6)
    assert wide == z()
