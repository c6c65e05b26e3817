"""Courses of events: stored entries, hashed neighbours, states as of a time, hops, profiles, removal, states in parts."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.operators import as_of, audit, balance, drift, forest, lineage, models, neighbours, quality, registry
from tollgate.plans import release
from tollgate.sources import bundles
from tollgate.sources.artifacts import settle
from tollgate.sources.registry_log import RegistryLog, StaleEntriesError
from tollgate.streaming import scoring
from tollgate import params as P


def labelled(spark, n=800, seed=1):
    r = random.Random(seed)
    rows = [(i, r.random() * 10, float(r.randrange(5)), r.gauss(0, 1)) for i in range(n)]
    rows = [(i, a, b, c, int(a + 2 * b + c + r.gauss(0, 2) > 9)) for i, a, b, c in rows]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int")


def test_nodes_score_as_the_forest_and_in_sql(spark, tmp_path):
    table, features = labelled(spark), ["a", "b", "c"]
    fitted = models.fit_forest(table, "id", features, n_estimators=7, max_depth=4)
    stored = forest.forest_nodes(fitted, table, features)
    nodes = stored.toPandas()
    mine = forest.score_nodes(table, stored, ["id"]).toPandas().sort_values("id")
    theirs = models.forest_scores(fitted, table, ["id"]).toPandas().sort_values("id")
    assert np.allclose(mine["probability"], theirs["probability"], atol=1e-12) and (mine["prediction"].values == theirs["prediction"].values).all()
    con = duckdb.connect()
    con.register("nodes", nodes)
    rows = table.toPandas()
    con.register("data", rows)
    walked = con.execute("""
        WITH RECURSIVE walk AS (
          SELECT id, tree, 0 AS node FROM data, (SELECT DISTINCT tree FROM nodes)
          UNION ALL
          SELECT w.id, w.tree, CAST(CASE WHEN CASE n.feature WHEN 'a' THEN d.a WHEN 'b' THEN d.b ELSE d.c END <= n.cut THEN n."left" ELSE n."right" END AS INTEGER)
          FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN data d ON d.id = w.id WHERE n."left" IS NOT NULL)
        SELECT id, avg(share) AS p FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n."left" IS NULL GROUP BY id ORDER BY id""").df()
    assert np.allclose(walked["p"], mine["probability"], atol=1e-12)


def test_null_features_go_right_and_no_forest_scores_null(spark):
    nodes = spark.createDataFrame([(0, 0, "a", 1.0, 1, 2, 9, 0.5), (0, 1, None, None, None, None, 4, 0.1), (0, 2, None, None, None, None, 5, 0.9)],
                                  "tree int, node int, feature string, cut double, left int, right int, rows long, share double")
    rows = spark.createDataFrame([(1, 1.0), (2, 1.5), (3, None)], "id long, a double")
    assert {r["id"]: r["probability"] for r in forest.score_nodes(rows, nodes, ["id"]).collect()} == {1: 0.1, 2: 0.9, 3: 0.9}
    assert {r["probability"] for r in forest.score_nodes(rows, nodes.limit(0), ["id"]).collect()} == {None}


def test_rows_walk_no_further_than_the_deepest_leaf(spark):
    """A chain of three cuts, a stump and a tree that is one leaf."""
    leaf = (None, None, None, None, 1)
    rows = [(0, 0, "a", 1.0, 1, 2, 9, 0.5), (0, 1, *leaf, 0.1), (0, 2, "b", 2.0, 3, 4, 8, 0.5), (0, 3, *leaf, 0.2), (0, 4, "a", 3.0, 5, 6, 7, 0.5),
            (0, 5, *leaf, 0.3), (0, 6, *leaf, 0.4), (1, 0, "b", 5.0, 1, 2, 9, 0.5), (1, 1, *leaf, 0.6), (1, 2, *leaf, 0.8), (2, 0, *leaf, 1.0)]
    nodes = spark.createDataFrame(rows, "tree int, node int, feature string, cut double, left int, right int, rows long, share double")
    inner = nodes.where("left is not null").collect()
    assert [forest._levels(inner, most) for most in (30, 3, 2)] == [3, 3, 2]
    assert forest._levels([r for r in inner if r["tree"] == 1], 30) == 1 and forest._levels([], 30) == 0
    table = spark.createDataFrame([(1, 0.0, 9.0), (2, 2.0, 1.0), (3, 2.0, 9.0), (4, 9.0, 9.0), (5, None, None)], "id long, a double, b double")
    scored = forest.score_nodes(table, nodes, ["id"])
    got = {r["id"]: r["probability"] for r in scored.collect()}
    want = {1: 0.1 + 0.8, 2: 0.2 + 0.6, 3: 0.3 + 0.8, 4: 0.4 + 0.8, 5: 0.4 + 0.8}
    assert got == pytest.approx({k: (v + 1.0) / 3 for k, v in want.items()}, abs=1e-15)
    leaves = nodes.where("node = 0 and tree = 2")
    assert {r["probability"] for r in forest.score_nodes(table, leaves, ["id"]).collect()} == {1.0}


ENTRY = "model string, number int, seq int, to_stage string"


def entry(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def test_log_stores_an_operation_once_and_refuses_the_stale(spark, tmp_path):
    schema = entry(spark, ("m", 1, 0, "staging")).schema
    log, other = (RegistryLog(spark, f"{tmp_path}/log", schema) for _ in range(2))
    assert log.entries().count() == 0 and log.operations() == []
    assert log.append(entry(spark, ("m", 1, 0, "staging"), ("m", 2, 0, "staging")), "first")
    assert not other.append(entry(spark, ("m", 1, 0, "staging"), ("m", 2, 0, "staging")), "first")
    assert other.append(entry(spark, ("m", 1, 1, "production"), ("m", 2, 1, "archived")), "second")
    for stale in (entry(spark, ("m", 1, 1, "archived")), entry(spark, ("m", 1, 3, "archived")), entry(spark, ("n", 1, 1, "staging")),
                  entry(spark, ("m", 1, 2, "a"), ("m", 1, 2, "b")), entry(spark, ("m", 1, 2, "a"), ("m", 1, 4, "b"))):
        with pytest.raises(StaleEntriesError):
            log.append(stale, "third")
    with pytest.raises(ValueError):
        log.append(entry(spark, ("m", 1, 2, "archived")), "a/b")
    assert log.operations() == ["first", "second"] and log.entries().count() == 4
    assert {(r["number"], r["stage"]) for r in registry.current_stage(log.entries().withColumn("ts", F.current_timestamp())).collect()} == {
        (1, "production"), (2, "archived")}


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The second reads the state before the first commits: its number is taken, it looks again, and is refused."""
    schema = entry(spark, ("m", 1, 0, "staging")).schema
    log, other = (RegistryLog(spark, f"{tmp_path}/log", schema) for _ in range(2))
    real, calls = other.operations, []
    commit = other._commit

    def late(number, operation):
        if not calls:
            calls.append(log.append(entry(spark, ("m", 1, 0, "staging")), "winner"))
        return commit(number, operation)

    monkeypatch.setattr(other, "_commit", late)
    with pytest.raises(StaleEntriesError):
        other.append(entry(spark, ("m", 1, 0, "production")), "loser")
    assert calls == [True] and real() == ["winner"] and [r["to_stage"] for r in log.entries().collect()] == ["staging"]
    # A writer whose entries do not touch the winner's goes on.
    calls.clear()
    monkeypatch.setattr(other, "_commit", lambda n, o: (calls or calls.append(log.append(entry(spark, ("m", 2, 0, "staging")), "next")), commit(n, o))[1])
    assert other.append(entry(spark, ("m", 3, 0, "staging")), "beside") and log.operations() == ["winner", "next", "beside"]


def test_stream_serves_a_forest_by_stage(spark, tmp_path):
    fields = list(P.REQUEST_DEFAULTS)
    rows = spark.range(300).select("id", *[(F.lit(d) * (F.rand(i) + 0.5)).alias(n) for i, (n, d) in enumerate(P.REQUEST_DEFAULTS.items())])
    rows = rows.withColumn("label", (F.col("mean_radius") < 14).cast("int")).cache()
    from tollgate.operators.features import fit_scaler
    scaler = fit_scaler(rows, fields)
    fitted = models.fit_forest(scaler.transform(rows), "id", fields, n_estimators=3, max_depth=3)
    path = bundles.save_bundle(bundles.Bundle(tuple(fields), fitted, scaler), spark, f"{tmp_path}/bundle")
    versions = spark.createDataFrame([("m", 4, "production", path)], "model string, number int, stage string, bundle string")
    bodies = [(1, "{}"), (2, '{"mean_radius": 3}'), (3, "no"), (4, None), (5, '{"mean_radius": "x"}')]
    spark.createDataFrame(bodies, "event_id long, body string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, body string").parquet(f"{tmp_path}/in")
    scoring.start_stage_scoring(stream, lambda: versions, "m", "production", f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/state").awaitTermination()
    good, bad = spark.read.parquet(f"{tmp_path}/out").collect(), spark.read.parquet(f"{tmp_path}/bad").collect()
    assert {(r["event_id"], r["model_version"]) for r in good} == {(1, "4"), (2, "4")} and {r["event_id"] for r in bad} == {3, 4, 5}
    assert all(0 <= r["probability"] <= 1 and len(r["patient_id"]) == 8 for r in good)


@pytest.mark.parametrize("n, width", [(6_000, 8), (3_000, 64)])
def test_hashed_neighbours_recall_and_visits(spark, monkeypatch, n, width):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 300)
    r = np.random.default_rng(width)
    centres = r.normal(size=(20, width)) * 2
    x = centres[r.integers(0, 20, n)] + r.normal(size=(n, width))
    names = [f"f{i}" for i in range(width)]
    df = spark.createDataFrame([(i, i % 2, *v) for i, v in enumerate(x.tolist())], "id long, part int, " + ", ".join(f"{c} double" for c in names))
    visits = []
    real = neighbours._salted_cogroup

    def counted(asked, rows, *rest):
        sizes = rows.groupBy("part", "leaf").count().join(asked.groupBy("part", "leaf").agg(F.count("*").alias("asks")), ["part", "leaf"])
        visits.append(sizes.agg(F.sum(F.col("count") * F.col("asks"))).first()[0] / n)
        return real(asked, rows, *rest)

    monkeypatch.setattr(neighbours, "_salted_cogroup", counted)
    got = neighbours.hashed_nearest(df, "id", names, 5, by="part", bucket_rows=300)
    found = {row["near"][0]["neighbour"]: {e["neighbour"] for e in row["near"][1:]} for row in got.select("near").collect()}
    hit = total = 0
    for part in (0, 1):
        ids = np.arange(part, n, 2)
        d = ((x[ids] ** 2).sum(1)[:, None] - 2 * x[ids] @ x[ids].T + (x[ids] ** 2).sum(1))
        np.fill_diagonal(d, np.inf)
        for i, near in zip(ids.tolist(), ids[np.argsort(d, axis=1)[:, :5]].tolist(), strict=True):
            hit, total = hit + len(found[i] & set(near)), total + 5
    assert hit / total >= 0.9, hit / total
    assert visits[0] <= 16 * 2 * 300


def test_hashed_smote_of_small_classes_and_copies(spark):
    rows = [(i, float(i % 40), 1.0, 0) for i in range(400)] + [(1000 + i, 5.0, 2.0, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    made = balance.smote(df, "id", ["a", "b"], hashed=True)
    assert {r["label"]: r["count"] for r in made.groupBy("label").count().collect()} == {0: 400, 1: 400}
    assert {(r["a"], r["b"]) for r in made.where("label = 1").select("a", "b").distinct().collect()} == {(5.0, 2.0)}


def test_large_leaves_are_dealt_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_LEAVES", 2)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 40)
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    df = spark.createDataFrame([(i, i % 3, *v) for i, v in enumerate(x.tolist())], "id long, part int, a double, b double, c double")
    lists = {row["near"][0]["neighbour"]: [e["neighbour"] for e in row["near"]] for row in neighbours.nearest(df, "id", ["a", "b", "c"], 4, 20, by="part").collect()}
    for i in range(400):
        mine = np.arange(i % 3, 400, 3)
        d = ((x[mine] - x[i]) ** 2).sum(axis=1)
        assert lists[i] == mine[np.lexsort((mine, d))][:5].tolist()


@pytest.mark.parametrize("span", [1, 50, 86_400])
def test_as_of_equals_a_plain_search(spark, span):
    r = random.Random(span)
    stamp = lambda s: None if s is None else np.datetime64("2024-01-01T00:00:00") + np.timedelta64(s, "s")
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, *range(300)])) for i in range(400)]
    changes = [(r.choice(["hot", "b", "c"]), r.randrange(0, 300, 3), r.choice([None, 1, 2, 3])) for _ in range(60)]
    text = lambda s: None if s is None else str(stamp(s))
    left = spark.createDataFrame([(i, k, text(s), "x") for i, k, s in rows], "id int, k string, t string, value string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame([(k, text(s), v) for k, s, v in changes], "k string, at string, held int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {x["id"]: x["held"] for x in as_of.as_of(left, right, ["k"], "t", "at", ["held"], span).collect()}
    assert len(got) == 400
    for i, k, s in rows:
        met = [(t, -1 if v is None else v) for c, t, v in changes if c == k and s is not None and t <= s]
        want = max(met)[1] if met else -1
        assert got[i] == (None if want == -1 else want)
    assert as_of.as_of(left, right.limit(0), ["k"], "t", "at", ["held"]).where("held IS NOT NULL").count() == 0


def test_hops_over_chains_circles_and_nothing(spark):
    links = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)] + [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self"), ("far", "gone")]
    got = {r["node"]: (r["origin"], r["hops"], r["looped"]) for r in lineage.lineage_hops(spark.createDataFrame(links, "node string, source string")).collect()}
    assert got == {**{f"c{i}": ("c0", i, False) for i in range(70)}, **{n: (None, None, True) for n in ("x", "y", "z", "into", "self")}, "far": ("gone", 1, False)}
    assert lineage.lineage_hops(spark.createDataFrame([], "node string, source string")).count() == 0


def test_profiles_merge_and_keep_new_categories(spark):
    r = random.Random(6)
    rows = [(r.choice([1.0, 2.0, 2.0, 5.0, float("nan"), None]), r.choice(["a", "b", None]), i % 2) for i in range(300)]
    rows += [(float(i), "new", 2) for i in range(40)]
    df = spark.createDataFrame(rows, "v double, c string, part int")
    reference = drift.reference_profile(df.where("part = 0"), ["v"], ["c"])
    whole = drift.fold_profile(df.where("part > 0"), reference, ["c"])
    halves = drift.merge_profiles(*[drift.fold_profile(df.where(f"part = {i}"), reference, ["c"]) for i in (1, 2)])
    key = lambda p: sorted((x["column"], x["bin"], x["n"]) for x in p.collect())
    assert key(whole) == key(halves) and ("c", "new", 40) in key(whole)
    two = drift.drift_columns(df.withColumn("is_current", F.col("part") > 0), ["v"], ["c"])
    want = {x["column"]: x["psi"] for x in two.collect()}
    got = {x["column"]: x["psi"] for x in drift.drift_from_profile(reference, halves).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_retention_leaves_other_files_alone(spark, tmp_path):
    log = spark.sql("SELECT explode(sequence(date'2023-11-01', date'2024-04-10')) AS date").select("date", F.trunc("date", "month").alias("month"), F.lit("x").alias("detail"))
    log.write.partitionBy("month").parquet(f"{tmp_path}/log")
    before = files(f"{tmp_path}/log")
    plan = {str(r["month"]): r["action"] for r in audit.apply_retention(spark, f"{tmp_path}/log", "2024-04-10").collect()}
    assert plan == {"2023-11-01": "drop", "2023-12-01": "drop", "2024-01-01": "rewrite", "2024-02-01": "keep", "2024-03-01": "keep", "2024-04-01": "keep"}
    after = files(f"{tmp_path}/log")
    kept = {f: t for f, t in before.items() if any(m in f for m in ("2024-02", "2024-03", "2024-04"))}
    assert {f: t for f, t in after.items() if "2024-01" not in f} == kept
    left = spark.read.parquet(f"{tmp_path}/log")
    assert (left.count(), str(left.agg(F.min("date")).first()[0])) == (91, "2024-01-11")
    audit.apply_retention(spark, f"{tmp_path}/log", "2024-04-10")
    assert files(f"{tmp_path}/log") == after


def test_states_of_parts_find_copies_across_them(spark):
    df = spark.createDataFrame([(1, 0.0), (1, -0.0), (2, None), (2, None), (3, float("nan")), (3, float("nan")), (4, 1.0)], "a long, b double")
    rows = df.collect()
    states = [quality.quality_state(spark.createDataFrame([r], df.schema), df.columns) for r in rows]
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    assert quality.merged_measures(whole, 2).collect() == quality.quality_measures(df, df.columns).collect()
    assert quality.merged_measures(whole.limit(0), 2).first()["n_rows"] == 0


def test_settle_removes_what_lies_in_between(spark, tmp_path, monkeypatch):
    from tollgate.sources import artifacts
    monkeypatch.setattr("tollgate.session._run", __import__("contextvars").ContextVar("run", default=str(tmp_path)))
    made = []

    def build():
        made.append(artifacts.materialize(spark.range(5), "between"))
        return made[0].where("id > 2")

    assert sorted(r["id"] for r in settle(spark, build, "kept").collect()) == [3, 4]
    assert [n.split("-")[0] for n in os.listdir(tmp_path)] == ["kept"]


def test_comparison_falls_back_to_the_runs_own_version(spark):
    versions = spark.createDataFrame([("m", 1, None, "local"), ("m", 2, None, "local"), ("n", 1, "staging", "staging"), ("n", 2, None, "local")],
                                     "model string, number int, stage string, environment string")
    own = spark.createDataFrame([("m", 1), ("n", 2)], "model string, number int")
    pairs = lambda df: {r["model"]: (r["champion"], r["challenger"]) for r in df.collect()}
    assert pairs(registry.comparison_pair(versions, own)) == {"m": (1, 1), "n": (1, 1)}
    assert pairs(registry.comparison_pair(versions)) == {"m": (2, 2), "n": (1, 1)}
