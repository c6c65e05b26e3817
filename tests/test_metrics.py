"""Pinned metric values, exact AUC against all pairs, comparison and recommendation limits."""

import random

import pytest
from pyspark.sql import functions as F

from tollgate.operators import compare, evaluate


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, probability double")


def test_pinned_metrics(spark):
    y, hit = [0, 0, 1, 1, 1, 0, 1, 0], [0, 1, 1, 1, 0, 0, 1, 0]
    row = evaluate.binary_metrics(scored(spark, [(a, b, 0.5) for a, b in zip(y, hit)])).first()
    assert (row.n, row.accuracy, row.precision, row.recall, row.f1_score) == (8, 6 / 8, 3 / 4, 3 / 4, 0.75)


def test_perfect_model(spark):
    row = evaluate.evaluate(scored(spark, [(0, 0, 0.1), (0, 0, 0.2), (1, 1, 0.8), (1, 1, 0.9)])).first()
    assert [row[m] for m in ("accuracy", "precision", "recall", "f1_score", "roc_auc")] == [1.0] * 5


def test_zero_denominators_and_one_class(spark):
    row = evaluate.evaluate(scored(spark, [(0, 0, 0.1), (0, 0, 0.4)])).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score, row.roc_auc) == (1.0, 0.0, 0.0, 0.0, None)


def test_empty_table(spark):
    row = evaluate.binary_metrics(scored(spark, [])).first()
    assert (row.n, row.accuracy, row.f1_score) == (0, 0.0, 0.0)
    assert evaluate.high_risk_summary(scored(spark, [])).first().high_risk_pct == 0.0


def all_pairs_auc(rows):
    pos = [p for y, _, p in rows if y == 1]
    neg = [p for y, _, p in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_auc_is_exact_with_ties_and_one_hot_score(spark, buckets):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), 0, 0.3) for _ in range(150)]
    rows += [(int(rng.random() < 0.6), 1, round(rng.random(), 2)) for _ in range(150)]
    rows += [(int(rng.random() < 0.4), 0, rng.random() * 1e-9) for _ in range(100)]
    df = scored(spark, rows)
    assert evaluate.roc_auc(df, buckets=buckets).first().roc_auc == pytest.approx(all_pairs_auc(rows), abs=1e-12)
    both = evaluate.evaluate(df, buckets=buckets).first()
    counted = evaluate.binary_metrics(df).first()
    assert both.roc_auc == pytest.approx(all_pairs_auc(rows), abs=1e-12)
    assert [both[c] for c in counted.asDict()] == list(counted)


def test_auc_per_segment_keeps_null_segments(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), 0, round(rng.random(), 1), seg) for seg in ("a", "b", None) for _ in range(60)]
    df = spark.createDataFrame(rows, "label int, prediction int, probability double, seg string")
    got = {r.seg: r.roc_auc for r in evaluate.roc_auc(df, ["seg"], buckets=5).collect()}
    for seg in ("a", "b", None):
        assert got[seg] == pytest.approx(all_pairs_auc([r[:3] for r in rows if r[3] == seg]), abs=1e-12)


def pair(spark, a, b, pa, pb):
    schema = "k int, prediction int, probability double"
    one = spark.createDataFrame([(i, x, p) for i, (x, p) in enumerate(zip(a, pa))], schema)
    two = spark.createDataFrame([(i, x, p) for i, (x, p) in enumerate(zip(b, pb))], schema)
    return one, two


def test_pinned_agreement_and_difference(spark):
    one, two = pair(spark, [0, 1, 1, 0, 1], [0, 1, 0, 0, 1], [.2, .8, .6, .3, .9], [.25, .75, .7, .35, .85])
    row = compare.comparison(compare.align(one, two, "k"), 3, 4).first()
    assert row.agreement_rate == 0.8
    assert row.avg_probability_diff == pytest.approx(0.06)
    assert row.max_probability_diff == pytest.approx(0.1)
    assert (row.champion_version, row.challenger_version, row.total_samples) == ("3", "4", 5)
    same = compare.comparison(compare.align(one, one, "k")).first()
    assert (same.agreement_rate, same.max_probability_diff) == (1.0, 0.0)


def test_repeated_and_unmatched_keys_are_counted_not_multiplied(spark):
    schema = "k int, prediction int, probability double"
    one = spark.createDataFrame([(1, 0, .1)] * 500 + [(2, 1, .9), (3, 1, .8)], schema)
    two = spark.createDataFrame([(1, 0, .1)] * 400 + [(2, 0, .4), (4, 1, .7)], schema)
    row = compare.alignment_counts(one, two, "k").first()
    assert (row.matched, row.champion_only, row.challenger_only, row.repeated) == (1, 1, 1, 1)
    assert [r.k for r in compare.align(one, two, "k").collect()] == [2]
    assert [r.k for r in compare.disagreements(compare.align(one, two, "k"), "k", 5).collect()] == [2]


@pytest.mark.parametrize("agreement, difference, expected", [
    (0.95, 0.0499, "SAFE TO PROMOTE"), (0.95, 0.05, "REVIEW RECOMMENDED"), (0.9499, 0.0, "REVIEW RECOMMENDED"),
    (0.85, 0.5, "REVIEW RECOMMENDED"), (0.8499, 0.0, "CAUTION")])
def test_recommendation_limits(spark, agreement, difference, expected):
    df = spark.createDataFrame([(agreement, difference)], "agreement_rate double, avg_probability_diff double")
    assert df.select(compare.recommendation().alias("r")).first().r == expected


def test_missing_metric_fails_the_performance_rows(spark):
    rows = evaluate.performance_rows(
        spark.createDataFrame([("accuracy", 0.7), ("precision", 0.9), ("f1_score", 0.8)], "metric string, value double"),
        {"accuracy": 0.7, "precision": 0.7, "recall": 0.7})
    got = {r.metric: (r.actual, r.result) for r in rows.collect()}
    assert got == {"accuracy": (0.7, "PASS"), "precision": (0.9, "PASS"), "recall": (0.0, "FAIL"),
                   "f1_score": (0.8, "INFO"), "roc_auc": (0.0, "INFO")}
    assert rows.where(F.col("threshold").isNull()).count() == 2
