"""Running totals and drift against plain Python, with hot values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tollgate.functions.running import running_totals
from tollgate.operators import drift


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_running_totals(spark, buckets):
    rng = random.Random(6)
    rows = [(g, x / 10, rng.randint(0, 9)) for g in ("a", None) for x in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    got = {(r.g, r.x): (r.n_below, r.n_total) for r in running_totals(df, "x", ["n"], ["g"], buckets).collect()}
    assert len(got) == len(rows)
    for g, x, _ in rows:
        same = [r for r in rows if r[0] == g]
        assert got[g, x] == (sum(n for _, y, n in same if y < x), sum(n for _, _, n in same))


def plain_drift(ref, cur):
    ref_sorted = sorted(ref)
    edges = [ref_sorted[math.ceil(q * len(ref) / 10) - 1] for q in range(1, 10)]
    where = lambda v: sum(e < v for e in edges)
    psi = 0.0
    for b in range(10):
        a = max(sum(where(v) == b for v in ref) / len(ref), 1e-4)
        c = max(sum(where(v) == b for v in cur) / len(cur), 1e-4)
        psi += (c - a) * math.log(c / a)
    share = lambda rows, v: sum(x <= v for x in rows) / len(rows)
    return psi, max(abs(share(ref, v) - share(cur, v)) for v in set(ref) | set(cur))


@pytest.mark.parametrize("buckets", [1, 9])
def test_drift_is_exact(spark, buckets):
    rng = random.Random(8)
    ref = [round(rng.gauss(0, 1), 1) for _ in range(200)] + [0.0] * 100
    cur = [round(rng.gauss(0.7, 1.5), 1) for _ in range(150)] + [9.9] * 70
    df = spark.createDataFrame([(x, False) for x in ref] + [(x, True) for x in cur], "x double, is_current boolean")
    row = drift.numeric_drift(df, ["x"], buckets=buckets).first()
    psi, ks = plain_drift(ref, cur)
    assert row.psi == pytest.approx(psi) and row.ks == pytest.approx(ks)


def test_score_alert_limit(spark):
    df = spark.createDataFrame([(i < 3,) for i in range(10)], "drifted boolean")
    assert drift.drift_score(df).first().alert is False
    df = spark.createDataFrame([(i < 4,) for i in range(10)], "drifted boolean")
    assert drift.retrain_trigger(drift.drift_score(df)).first().retrain is True


def test_same_tables_do_not_drift(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.array(F.lit(True), F.lit(False)).alias("s")).select(
        "x", F.explode("s").alias("is_current"), F.lit("c").alias("kind"))
    rows = drift.drift_columns(df, ["x"], ["kind"]).collect()
    assert all(abs(r.psi) < 1e-12 and not r.drifted for r in rows)
