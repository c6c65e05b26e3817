"""Split, balance, scaling, components and models: exactness, invariance and no leakage."""

import random
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.operators import balance, features, gates, models, neighbours, scoring, split
from tollgate.plans import training
from tollgate.sources import artifacts, tables


def labelled(spark, n=500, share=0.3, seed=5):
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < share), round(rng.gauss(0, 1), 3), float(rng.randint(0, 3))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, a double, b double")


def test_split_is_exact_disjoint_and_independent_of_partitions(spark):
    df = labelled(spark)
    one = split.stratified_split(df, "id")
    two = split.stratified_split(df.repartition(7, "a"), "id")
    first, second = ({r.id: r.split for r in x.collect()} for x in (one, two))
    assert first == second and len(first) == 500
    counts = {(r.label, r.split): r["count"] for r in one.groupBy("label", "split").count().collect()}
    ones = counts[1, "test"] + counts[1, "train"]
    assert counts[0, "test"] + counts[1, "test"] == ceil(0.2 * 500)
    assert abs(counts[1, "test"] - ones * 0.2) < 1


def test_split_descends_into_large_prefixes(spark, monkeypatch):
    df = labelled(spark, 3000)
    expected = {r.id for r in split.stratified_split(df, "id").where("split = 'test'").collect()}
    monkeypatch.setattr(split, "PREFIX_STEP", 1)
    assert {r.id for r in split.stratified_split(df, "id").where("split = 'test'").collect()} == expected


@pytest.mark.parametrize("literal, rows", [(0, 50_000), (64, 3)])
def test_split_by_tables_and_by_fine_ranges_is_the_same(spark, monkeypatch, literal, rows):
    df = labelled(spark, 700).withColumn("label", F.col("id") % 5)
    expected = {r.id: r.split for r in split.stratified_split(df, "id", test_size=0.23).collect()}
    monkeypatch.setattr(split, "PREFIX_STEP", 1)
    monkeypatch.setattr(split, "LITERAL_CLASSES", literal)
    monkeypatch.setattr(split, "RANGE_ROWS", rows)
    assert {r.id: r.split for r in split.stratified_split(df, "id", test_size=0.23).collect()} == expected
    none = split.stratified_split(df, "id", test_size=0.0)
    assert none.where("split = 'test'").count() == 0


def test_split_rejects_a_class_with_one_row(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label int")
    with pytest.raises(split.SplitError):
        split.fit_split(df, "id")


def test_split_rejects_a_repeated_key(spark):
    df = spark.createDataFrame([(1, i % 2) for i in range(100)], "id long, label int")
    with pytest.raises(split.SplitError, match="not unique"):
        split.fit_split(df, "id")


def test_split_of_many_classes_and_of_null_labels(spark):
    rows = [(i, i % 1500) for i in range(6000)] + [(10_000 + i, None) for i in range(5)]
    got = split.stratified_split(spark.createDataFrame(rows, "id long, label int"), "id").collect()
    assert sum(r.split == "test" for r in got) == 1200 and {r.split for r in got if r.label is None} == {None}
    parts = {}
    for r in got:
        parts.setdefault(r.label, []).append(r.split)
    assert all(p.count("test") in (0, 1) for c, p in parts.items() if c is not None)


def test_smote_of_many_classes_and_of_missing_features(spark):
    rows = [(i, float(i % 7), float(i // 1500), i % 300) for i in range(2100)] + [(9000 + i, float(i), 0.5, 300) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    got = {r.label: r["count"] for r in balance.smote(df, "id", ["a", "b"]).groupBy("label").count().collect()}
    assert len(got) == 301 and set(got.values()) == {9}
    with pytest.raises(ValueError, match="null or NaN"):
        balance.smote(df.withColumn("a", F.when(F.col("id") != 4, F.col("a"))), "id", ["a", "b"])


def test_inference_sample_is_the_same_on_any_partitioning(spark):
    df = labelled(spark)
    ids = [sorted(r.id for r in split.inference_sample(d, "id").collect()) for d in (df, df.repartition(9))]
    assert ids[0] == ids[1] and len(set(ids[0])) == 200
    assert split.inference_sample(df.limit(50), "id").count() == 50


def plain_distance(x, y):
    total = 0.0  # added one by one: sum() corrects its rounding
    for a, b in zip(x, y):
        total += (a - b) * (a - b)
    return total


def brute_force(rows, k):
    out = {}
    for key, x in rows:
        near = sorted((plain_distance(x, y), other) for other, y in rows if other != key)
        out[key] = near[:k]
    return out


@pytest.mark.parametrize("leaf_rows, group_rows", [(10_000, 20_000), (40, 20_000), (5, 20_000), (40, 3)])
def test_nearest_equals_brute_force_with_a_hot_vector(spark, monkeypatch, leaf_rows, group_rows):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", group_rows)
    rng = random.Random(9)
    rows = [(i, (1.0, 2.0, 3.0)) for i in range(120)]
    rows += [(120 + i, (float(rng.randint(0, 6)), round(rng.gauss(2, 2), 1), rng.random())) for i in range(240)]
    df = spark.createDataFrame([(k, *x) for k, x in rows], "id long, a double, b double, c double")
    lists = {(r.a, r.b, r.c): r.near for r in neighbours.nearest(df, "id", ["a", "b", "c"], 5, leaf_rows).collect()}
    expected = brute_force(rows, 5)
    for key, x in rows:
        found = [(e.distance2, e.neighbour) for e in lists[x] if e.neighbour != key][:5]
        assert found == expected[key]


def test_smote_balances_and_keeps_originals(spark):
    df = labelled(spark, 300, 0.15)
    made = balance.smote(df, "id", ["a", "b"], leaf_rows=10).cache()
    counts = {r.label: r["count"] for r in made.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    kept = {(int(r.id), r.label, r.a, r.b) for r in made.where("not synthetic").collect()}
    assert kept == {(r.id, r.label, r.a, r.b) for r in df.collect()}
    again = balance.smote(df.repartition(6, "a"), "id", ["a", "b"], leaf_rows=40)
    rows = lambda d: sorted((r.id, r.label, r.a, r.b) for r in d.collect())
    assert rows(made) == rows(again)
    assert made.where("synthetic").select("label").distinct().collect()[0].label == 1


def test_smote_needs_more_rows_than_neighbours(spark):
    df = spark.createDataFrame([(i, int(i < 5), float(i)) for i in range(50)], "id long, label int, a double")
    with pytest.raises(ValueError, match="5 rows"):
        balance.smote(df, "id", ["a"])


def test_balance_leaves_an_even_table_alone(spark):
    df = labelled(spark, 200, 0.45)
    assert balance.balance(df, "id", ["a", "b"]).count() == 200
    assert balance.balance(labelled(spark, 200, 0.1), "id", ["a", "b"], enabled=False).count() == 200


def test_scaler(spark):
    df = spark.createDataFrame([(float(i % 7), 5.0) for i in range(100)], "x double, c double")
    scaled = features.fit_scaler(df, ["x", "c"]).transform(df)
    row = scaled.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max(F.abs("c")).alias("c")).first()
    assert abs(row.m) < 1e-10 and abs(row.s - 1) < 1e-10 and row.c == 0.0


def test_scaler_ignores_the_test_part(spark):
    table = split.stratified_split(labelled(spark), "id")
    stats = lambda t: features.fit_scaler(t.where("split = 'train'"), ["a"])
    shifted = lambda part: table.withColumn("a", F.when(F.col("split") == part, F.col("a") + 9).otherwise(F.col("a")))
    assert stats(table) == stats(shifted("test"))
    assert stats(table) != stats(shifted("train"))


def test_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    fitted = features.fit_components(df, "features", 6, 4)
    loadings = fitted.loadings
    assert np.allclose(loadings.T @ loadings, np.eye(4), atol=1e-9)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(fitted.explained, values[:4] / values.sum(), atol=1e-9)
    assert fitted.explained == sorted(fitted.explained, reverse=True)
    got = np.array([[r[f"PC{i + 1}"] for i in range(4)] for r in fitted.transform(df, keep=["id"]).orderBy("id").collect()])
    assert np.allclose(got, x @ loadings, atol=1e-9)
    assert (loadings[np.abs(loadings).argmax(axis=0), range(4)] > 0).all()


def test_components_gate():
    assert not features.use_components(50, True) and features.use_components(51, True) and not features.use_components(64, False)


def test_gaussian_scaled_equals_unscaled_and_survives_a_round_trip(spark):
    df = labelled(spark)
    names = ["a", "b"]
    plain, scaled = (models.fit_gaussian(df, names, scaled=s) for s in (False, True))
    p = lambda m: {r.id: r.probability for r in scoring.score(m, df, ["id"]).collect()}
    first, second = p(plain), p(scaled)
    assert all(abs(first[k] - second[k]) < 1e-9 for k in first)
    direct = features.fit_scaler(df, names)
    assert np.allclose(scaled.scaler.mean, direct.mean) and np.allclose(scaled.scaler.std, direct.std)
    stored = artifacts.materialize(scaled.table(spark), "coefficients")
    assert p(models.GaussianModel.from_table(stored, names)) == second


def test_forest_is_the_same_on_any_partitioning(spark):
    df = labelled(spark)
    df = df.withColumn("label", (F.col("a") + F.col("b") / 2 > 0.5).cast("int"))
    fit = lambda d: models.fit_forest(d, "id", ["a", "b"], n_estimators=5, max_depth=4)
    scores = [{r.id: (r.prediction, r.probability) for r in models.forest_scores(fit(d), df, ["id"]).collect()}
              for d in (df, df.repartition(11, "b"))]
    assert scores[0] == scores[1]
    assert all(0 <= p <= 1 and hit == int(p > 0.5) for hit, p in scores[0].values())


def test_scoring_with_a_foreign_model(spark):
    class Stump:
        """A Python model as another library would give it."""

        def predict_proba(self, x):
            p = 1 / (1 + np.exp(-x[:, 0]))
            return np.column_stack([1 - p, p])

    df = labelled(spark, 50)
    rows = scoring.score_in_pandas(df, ["id"], ["a", "b"], Stump).collect()
    values = {r.id: r.a for r in df.collect()}
    assert len(rows) == 50
    for r in rows:
        assert r.probability == pytest.approx(1 / (1 + np.exp(-values[r.id]))) and r.prediction == int(r.probability > 0.5)


def test_flow_gates_raise(spark, folder):
    noise = tables.noise_orders(spark, folder)
    params = P.TrainingParams(n_estimators=5, max_depth=3)
    with pytest.raises(gates.GateError):
        training.training_flow(noise, tables.ORDER_KEY, tables.ORDER_FEATURES, params)


def test_flow_with_resampling_and_components(spark, folder):
    rare = tables.large_order(spark, folder, tables.RARE_LARGE_ORDER)
    params = P.TrainingParams(n_estimators=5, max_depth=4, enable_resampling=True, enable_pca=True, max_features_for_pca=3,
                              pca_components=4, min_accuracy=0.0, min_precision=0.0, min_recall=0.0)
    run = training.training_flow(rare, tables.ORDER_KEY, tables.ORDER_FEATURES, params)
    rows = {(r.dataset, r.check): r for r in run.report.collect()}
    assert len(rows) == 11 and len(run.components.sign) == 4
    train_rows = rows["train", "minimum_rows"].actual
    assert train_rows > split.stratified_split(rare, tables.ORDER_KEY).where("split = 'train'").count()


def test_other_source_formats(spark, tmp_path):
    df = labelled(spark, 20)
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    df.write.json(str(tmp_path / "json"))
    for fmt, options in (("csv", {"header": "true"}), ("json", {})):
        read = tables.read_labelled(spark, str(tmp_path / fmt), "id", ["a", "b"], file_format=fmt,
                                    schema=df.schema.simpleString()[7:-1].replace(":", " "), **options)
        assert sorted(map(tuple, read.collect())) == sorted((r.id, r.a, r.b, r.label) for r in df.collect())
