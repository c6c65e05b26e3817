"""Data-quality checks at their limits, on edge tables, and with hot repeated rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tollgate.operators import quality

NAN = float("nan")


def test_row_limit_is_inclusive(spark):
    for n, passes in ((99, False), (100, True)):
        df = spark.range(n).select(F.col("id").cast("double").alias("x"))
        row = quality.quality_verdict(quality.quality_measures(df, ["x"])).first()
        assert (row.passed, row.first_failure) == (passes, None if passes else "min_rows")


def test_missing_limit_is_inclusive_and_counts_nan(spark):
    rows = [(None, 1.0)] * 10 + [(NAN, 2.0)] * 10 + [(1.0, float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "a double, b double")
    row = quality.quality_verdict(quality.quality_measures(df, ["a", "b"])).first()
    assert (row.missing_cells, row.missing_fraction, row.passed) == (20, 0.1, True)
    worse = df.union(spark.createDataFrame([(None, None)], "a double, b double"))
    assert quality.quality_verdict(quality.quality_measures(worse, ["a", "b"])).first().first_failure == "missing_fraction"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    row = quality.quality_measures(df, ["a", "b"]).first()
    assert (row.n_rows, row.missing_cells, row.duplicate_rows, row.missing_fraction) == (0, 0, 0, 0.0)
    assert {(r.column, r.missing_count, r.missing_pct) for r in quality.column_profile(df).collect()} == {("a", 0, None), ("b", 0, None)}


def test_repeats_count_nulls_nan_and_zero_as_equal(spark):
    rows = [(None, "x"), (None, "x"), (NAN, None), (NAN, None), (0.0, "z"), (-0.0, "z"), (1.0, "a"), (1.0, "b")]
    df = spark.createDataFrame(rows, "a double, b string")
    assert quality.quality_measures(df, ["a", "b"]).first().duplicate_rows == 3


def test_repeats_with_one_row_a_third_of_the_table(spark):
    rng = random.Random(3)
    rows = [(7.0, "hot", "train")] * 300 + [(float(rng.randint(0, 40)), rng.choice("abc"), rng.choice(["train", "test"])) for _ in range(600)]
    df = spark.createDataFrame(rows, "a double, b string, split string").repartition(5)
    expected = sum(n - 1 for n in Counter(rows).values())
    assert quality.quality_measures(df, ["a", "b", "split"]).first().duplicate_rows == expected
    per_split = {r.split: r.duplicate_rows for r in quality.quality_measures(df, ["a", "b"], ["split"]).collect()}
    for split in ("train", "test"):
        assert per_split[split] == sum(n - 1 for n in Counter(r for r in rows if r[2] == split).values())


def test_gate_returns_its_input_or_raises(spark):
    good = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert quality.require_quality(good, ["x"]) is good
    with pytest.raises(quality.QualityError, match="99 rows"):
        quality.require_quality(good.limit(99), ["x"])
    with pytest.raises(quality.QualityError, match="missing"):
        quality.require_quality(good.withColumn("x", F.when(F.col("x") > 50, F.col("x"))), ["x"])


def test_profile_of_an_all_null_column(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a double, b int")
    got = {r.column: (r.dtype, r.missing_count, r.missing_pct, r.n_rows, r.n_cols) for r in quality.column_profile(df).collect()}
    assert got == {"a": ("double", 2, 100.0, 2, 2), "b": ("int", 0, 0.0, 2, 2)}


@pytest.mark.parametrize("ones, zeros, resample", [(30, 70, False), (29, 71, True), (10, 0, False)])
def test_resample_decision(spark, ones, zeros, resample):
    df = spark.createDataFrame([(1,)] * ones + [(0,)] * zeros + [(None,)] * 5, "label int")
    assert quality.resample_decision(df).first().resample is resample
    assert quality.resample_decision(df, enabled=False).first().resample is False


def test_drop_incomplete_covers_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "b"), (None, "c"), (2.0, None)], "x double, y string")
    assert [r.x for r in quality.drop_incomplete(df).collect()] == [1.0]
