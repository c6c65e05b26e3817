"""The registered queries agree with their SQL on the smallest tables, and a wrong build would not."""

import pytest
from pyspark.sql import functions as F

from checks.catalog import QUERIES
from checks.oracle import ORACLES
from checks.run import connect, rows_of
from tollgate import params as P
from tollgate.operators import features
from tollgate.functions import scalars

pytestmark = pytest.mark.usefixtures("folder")


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def agrees(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    cursor = con.execute(ORACLES[name])
    return rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [
    "flagship_train_eval_gate", "smote_exact", "dq_gate", "comparison_metrics", "promotion_gate", "rollback_plan",
    "lineage_trace", "drift_score", "stream_score", "stream_monitor", "manifest_validation", "listing_by_model", "top_disagreements"])
def test_query_agrees_with_sql(spark, folder, con, name):
    assert agrees(spark, folder, con, name)


def test_sample_deviation_would_be_noticed(spark, folder, con, monkeypatch):
    assert agrees(spark, folder, con, "scaler_stats")
    monkeypatch.setattr(features.F, "stddev_pop", F.stddev_samp)
    assert not agrees(spark, folder, con, "scaler_stats")


def test_other_limits_would_be_noticed(spark, folder, con, monkeypatch):
    assert agrees(spark, folder, con, "risk_tier")
    monkeypatch.setattr(scalars.P, "TIER_LOW_ABOVE", 0.69)
    assert not agrees(spark, folder, con, "risk_tier")
    monkeypatch.setattr(P, "STEP_GATE", P.Gate("step", {m: 0.75 for m in P.GATED_METRICS}, "zero"))
    assert not agrees(spark, folder, con, "step_gate")
