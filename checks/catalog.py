"""One query per operator. Each reads whole tables below ``folder`` and returns flat, rounded columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import params as P
from tollgate.functions.scalars import (
    key_hash, reasons, risk_tier, round_probability, run_url, short_id, version_url)
from tollgate.operators import audit, balance, compare, drift, evaluate, features, gates, lineage, manifests, models
from tollgate.operators import policy, quality, registry, scoring, split
from tollgate.plans import comparison, environments, training
from tollgate.session import work_folder
from tollgate.sources import artifacts as store
from tollgate.sources import bundles
from tollgate.sources import registry_tables as reg
from tollgate.sources import requests as req
from tollgate.sources import tables as src
from tollgate.streaming import monitor, scoring as stream_scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY, FEATURES = src.ORDER_KEY, list(src.ORDER_FEATURES)
EXPORTED_AT = "2024-06-01T12:00:00"
IMPORTED_AT = "2024-06-01T13:00:00"
EXCHANGE = "exchange"


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def tidy(df: DataFrame, places: int | None = 6) -> DataFrame:
    """Flat columns that compare exactly: rounded doubles (unless ``places`` is None), text for arrays and times."""
    def flat(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = column if places is None else F.bround(column, places)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "; ")
        return column.alias(field.name)
    return df.select(*[flat(f) for f in df.schema.fields])


# --- Sources, sinks -------------------------------------------------------------------------------------------------

@query("load_labelled")
def load_labelled(spark, folder):
    return tidy(src.large_order(spark, folder))


@query("load_noise_labels")
def load_noise_labels(spark, folder):
    return tidy(src.noise_orders(spark, folder))


@query("load_toxic_documents")
def load_toxic_documents(spark, folder):
    return tidy(src.toxic_docs(spark, folder))


@query("inference_sample")
def inference_sample(spark, folder):
    return tidy(split.inference_sample(src.large_order(spark, folder), KEY))


@query("artifact_round_trip")
def artifact_round_trip(spark, folder):
    return tidy(store.materialize(src.large_order(spark, folder), "artifact"))


def _exported(spark, folder):
    versions = store.materialize(reg.model_versions(spark, folder), "versions")
    return manifests.export_manifests(
        versions, reg.version_metrics(spark, folder), reg.promotion_events(spark, folder, versions), EXCHANGE, EXPORTED_AT)


def _manifest_columns(parsed: DataFrame) -> DataFrame:
    chain = F.transform("promotion_chain", lambda e: F.concat_ws(
        ">", e["action"], F.coalesce(e["from_stage"], F.lit("-")), F.coalesce(e["to_stage"], F.lit("-"))))
    shown = F.transform(F.array_sort(F.map_entries("metrics")), lambda e: F.concat(
        e["key"], F.lit("="), F.format_string("%.6f", F.bround(e["value"], 6))))
    return tidy(parsed.select(
        F.col("model_name").alias("model"), F.col("source.model_version").alias("number"), "export_path",
        F.col("source.workspace").alias("workspace"), F.col("source.stage").alias("stage"),
        F.col("source.model_version_url").alias("model_version_url"),
        F.col("source.training_run_url").alias("training_run_url"), F.col("source.created_at").alias("created_at"),
        F.col("artifacts.model").alias("model_path"), F.col("artifacts.scaler").alias("scaler_path"),
        shown.alias("metrics"), chain.alias("chain")))


@query("manifest_round_trip")
def manifest_round_trip(spark, folder):
    path = store.write_manifests(manifests.manifest_json(_exported(spark, folder)), work_folder(spark, "manifests"))
    return _manifest_columns(store.read_manifests(spark, path))


@query("training_report_rows")
def training_report_rows(spark, folder):
    params = P.TrainingParams()
    table = training.split_table(src.large_order(spark, folder), KEY)
    model = models.fit_gaussian(table.where("split = 'train'"), FEATURES)
    metrics = evaluate.evaluate(scoring.score(model, table.where("split = 'test'"), [KEY, "label"]))
    rows = training.split_report(table, FEATURES).unionByName(training.performance_report(metrics, params))
    return tidy(store.materialize(rows, "report"))


@query("in_flow_decision")
def in_flow_decision(spark, folder):
    """The decision inside a run: the train table's, the test table's and the metrics' checks together."""
    return gates.overall_decision(training_report_rows(spark, folder))


@query("registry_listing")
def registry_listing(spark, folder):
    versions = registry.newest_first(reg.model_versions(spark, folder))
    return tidy(versions.select("model", "number", "stage", "created", "updated"))


@query("listing_by_model")
def listing_by_model(spark, folder):
    return registry.newest_per_model(reg.model_versions(spark, folder)).select("model", "number", "stage", "place")


@query("latest_training_run")
def latest_training_run(spark, folder):
    runs = reg.flow_runs(reg.step_runs(spark, folder)).where("flow = 'training'")
    return tidy(runs.orderBy(F.col("start_time").desc(), F.col("run_id").desc()).limit(1)
                .select("run_id", "flow", "status", "start_time", "n_steps"))


# --- Projections ----------------------------------------------------------------------------------------------------

def _requests(spark, folder):
    return req.request_bodies(req.read_events(spark, folder))


@query("request_defaults")
def request_defaults(spark, folder):
    return tidy(req.valid_requests(req.parse_requests(_requests(spark, folder))).drop("ts"), None)


BODIES = ["not json", '{"mean_radius":', '{"mean_radius": "abc"}', '{"mean_radius": "20.5"}', '{"mean_radius": null}', "[1]", None,
          '{"mean_radius": 12.25, "age": 3}', "{}"]


@query("request_validation")
def request_validation(spark, folder):
    """A body per event, most of them wrong in some way."""
    body = F.element_at(F.array(*[F.lit(b) for b in BODIES]), (F.col("event_id") % len(BODIES) + 1).cast("int"))
    parsed = req.parse_requests(req.read_events(spark, folder).select("event_id", body.alias("body")))
    accepted = req.valid_requests(parsed).select("event_id", F.lit(None).cast("string").alias("problem"), "mean_radius", "worst_area")
    refused = req.rejected_requests(parsed).withColumns({"mean_radius": F.lit(None).cast("double"), "worst_area": F.lit(None).cast("double")})
    return accepted.unionByName(refused)


def _order_scores(spark, folder):
    return reg.scored_orders(spark, folder)


@query("risk_tier")
def risk_tier_query(spark, folder):
    return _order_scores(spark, folder).select(KEY, risk_tier("probability").alias("risk_level"))


@query("reason_lists")
def reason_lists(spark, folder):
    parsed = req.parse_requests(_requests(spark, folder))
    return tidy(parsed.select(
        "event_id", reasons(P.RISK_REASONS).alias("top_risk_factors"),
        reasons(P.PROTECTIVE_REASONS).alias("protective_factors")))


@query("rounded_probability")
def rounded_probability(spark, folder):
    return _order_scores(spark, folder).select(KEY, round_probability("probability").alias("probability"))


@query("short_id")
def short_id_query(spark, folder):
    return src.table(spark, folder, "events").select("event_id", short_id("event_id").alias("patient_id"))


@query("environment_tag")
def environment_tag(spark, folder):
    untagged = reg.model_versions(spark, folder).drop("environment")
    return policy.tag_environment(untagged, "staging").select("model", "number", "environment")


@query("tag_policy")
def tag_policy(spark, folder):
    return tidy(reg.model_versions(spark, folder).select(
        "model", "number", policy.missing_tag_prefixes().alias("missing_prefixes")))


@query("name_policy")
def name_policy(spark, folder):
    return reg.model_versions(spark, folder).select("model", "number", policy.valid_name().alias("name_ok"))


@query("commit_policy")
def commit_policy(spark, folder):
    return reg.model_versions(spark, folder).select("model", "number", policy.has_commit().alias("commit_ok"))


@query("audit_urls")
def audit_urls(spark, folder):
    here = F.lit(P.DEV_WORKSPACE)
    return reg.model_versions(spark, folder).select(
        "model", "number", version_url(here, F.col("version_id")).alias("model_version_url"),
        run_url(here, F.col("training_run_id")).alias("training_run_url"))


def _metadata(spark, folder):
    """Raw metadata of every version: bare numbers, wrapped numbers, text, a list that is dropped, and the chain."""
    metrics = reg.version_metrics(spark, folder)
    number = F.format_string("%.6f", F.bround("value", 6))
    wrapped = F.when(F.col("number") % 2 == 0, number).otherwise(F.concat(F.lit('{"value": '), number, F.lit("}")))
    rows = metrics.select("model", "number", F.col("metric").alias("name"), wrapped.alias("raw"))
    versions = store.materialize(reg.model_versions(spark, folder), "versions")
    entry = lambda name, raw: F.struct(F.lit(name).alias("name"), raw.alias("raw"))
    other = versions.select("model", "number", F.inline(F.array(
        entry("environment", F.to_json(F.struct(F.col("environment").alias("value")))),
        entry("environment_text", F.concat(F.lit('"'), F.coalesce("environment", F.lit("none")), F.lit('"'))),
        entry("governed", F.lit("true")),
        entry("folds", F.lit("[1, 2, 3]")),
    )))
    events = reg.promotion_events(spark, folder, versions)
    chain = F.to_json(F.transform("chain", lambda e: F.struct(
        e["action"].alias("action"), e["from_stage"].alias("from_stage"), e["to_stage"].alias("to_stage"))))
    quoted = F.concat(F.lit('"'), F.replace(chain, F.lit('"'), F.lit('\\"')), F.lit('"'))
    chains = registry.chains(events).select(
        "model", "number", F.lit("promotion_chain").alias("name"),
        F.when(F.col("number") % 2 == 0, chain).otherwise(quoted).alias("raw"))
    return rows.unionByName(other).unionByName(chains)


@query("metadata_unwrap")
def metadata_unwrap(spark, folder):
    metadata = store.materialize(_metadata(spark, folder), "metadata")
    steps = F.transform("chain", lambda e: F.concat(e["from_stage"], F.lit(">"), e["to_stage"]))
    chains = manifests.unwrap_chains(metadata).select(
        "model", "number", F.lit("promotion_chain").alias("name"), F.array_join(steps, "; ").alias("text"),
        F.lit(None).cast("double").alias("value"))
    # The text of a number depends on how it was written, so numbers are shown by value only.
    shown = F.when(F.col("value").isNull(), F.col("text")).alias("text")
    return tidy(manifests.unwrap_metadata(metadata).unionByName(chains).select("model", "number", "name", shown, "value"))


@query("drop_incomplete")
def drop_incomplete(spark, folder):
    kept = quality.drop_incomplete(src.dirty_lineitem(spark, folder))
    return tidy(kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                            "l_discount", "l_tax"))


# --- Data quality ---------------------------------------------------------------------------------------------------

DIRTY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]


@query("dq_min_rows")
def dq_min_rows(spark, folder):
    counted = quality.missing_counts(src.table(spark, folder, "supplier"), ["s_suppkey"])
    return counted.select("n_rows", F.lit(P.MIN_ROWS).alias("min_rows"), (F.col("n_rows") >= P.MIN_ROWS).alias("passed"))


@query("dq_missing_fraction")
def dq_missing_fraction(spark, folder):
    counted = quality.missing_counts(src.dirty_lineitem(spark, folder), DIRTY)
    share = F.col("missing_cells") / (F.col("n_rows") * len(DIRTY))
    return tidy(counted.select("n_rows", "missing_cells", share.alias("missing_fraction"),
                               (share <= P.MAX_MISSING_FRACTION).alias("passed")))


@query("dq_duplicates")
def dq_duplicates(spark, folder):
    return quality.repeated_rows(src.dirty_lineitem(spark, folder), DIRTY)


@query("dq_gate")
def dq_gate(spark, folder):
    return tidy(quality.quality_verdict(quality.quality_measures(src.dirty_lineitem(spark, folder), DIRTY)))


@query("column_profile")
def column_profile(spark, folder):
    return tidy(quality.column_profile(src.dirty_lineitem(spark, folder)))


def _split_table(spark, folder, limit=src.LARGE_ORDER):
    return training.split_table(src.large_order(spark, folder, limit), KEY)


@query("dq_report_by_split")
def dq_report_by_split(spark, folder):
    return tidy(training.split_report(_split_table(spark, folder), FEATURES))


@query("class_distribution")
def class_distribution(spark, folder):
    return quality.class_distribution(src.toxic_docs(spark, folder).select("label"))


@query("resample_decision")
def resample_decision(spark, folder):
    even = quality.resample_decision(src.large_order(spark, folder))
    rare = quality.resample_decision(src.large_order(spark, folder, src.RARE_LARGE_ORDER))
    named = lambda df, name: df.withColumn("dataset", F.lit(name))
    return tidy(named(even, "large").unionByName(named(rare, "rare")))


@query("high_risk_summary")
def high_risk_summary(spark, folder):
    return tidy(evaluate.high_risk_summary(_order_scores(spark, folder), by=["model"]))


# --- Split, balance, features ---------------------------------------------------------------------------------------

@query("stratified_split")
def stratified_split(spark, folder):
    return split.stratified_split(src.large_order(spark, folder), KEY).select(KEY, "label", "split")


@query("smote_exact")
def smote_exact(spark, folder):
    rare = src.large_order(spark, folder, src.RARE_LARGE_ORDER)
    table = store.materialize(rare, "rare")
    made = balance.balance(table, KEY, FEATURES)
    return tidy(made, 5)


@query("scaler_stats")
def scaler_stats(spark, folder):
    return tidy(features.scaler_stats(_split_table(spark, folder).where("split = 'train'"), FEATURES))


@query("scaled_features")
def scaled_features(spark, folder):
    table = _split_table(spark, folder)
    return tidy(features.fit_scaler(table.where("split = 'train'"), FEATURES).transform(table))


def _wide(spark, folder):
    return src.wide_vectors(spark, folder)


@query("pca_gate")
def pca_gate(spark, folder):
    vectors = _wide(spark, folder).agg(F.max(F.size("features")).alias("n_features"), F.count(F.lit(1)).alias("n_rows"))
    return vectors.select("n_rows", "n_features", (F.col("n_features") > P.TrainingParams().max_features_for_pca).alias("use_pca"))


def _components(spark, folder):
    vectors = _wide(spark, folder)
    count = vectors.select(F.size("features").alias("n")).first()["n"]
    scaled, _ = features.scale_array(vectors, "features", count)
    scaled = store.materialize(scaled, "scaled")
    return scaled, features.fit_components(scaled, "features", count)


@query("pca_components")
def pca_components(spark, folder):
    scaled, fitted = _components(spark, folder)
    return tidy(fitted.transform(scaled, "features", ["vec_id"]))


@query("pca_checks")
def pca_checks(spark, folder):
    """What makes components components, against a covariance summed by plain aggregates over all rows."""
    scaled, fitted = _components(spark, folder)
    cells = scaled.select("vec_id", F.posexplode("features").alias("i", "x"))
    pairs = cells.join(cells.toDF("vec_id", "j", "y"), "vec_id").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("c"))
    size = max(r["i"] for r in cells.agg(F.max("i").alias("i")).collect()) + 1
    cov = np.zeros((size, size))
    for r in pairs.collect():  # features x features numbers
        cov[r["i"], r["j"]] = r["c"]
    v, share = fitted.loadings, np.array(fitted.explained)
    values = share * np.trace(cov)
    scores = fitted.transform(scaled, "features", ["vec_id"])
    spread = scores.agg(*[F.var_samp(f"PC{k + 1}").alias(f"v{k}") for k in range(len(values))]).first()
    checks = {
        "eigenvectors": np.abs(cov @ v - v * values).max() < 1e-8,
        "orthonormal": np.abs(v.T @ v - np.eye(len(values))).max() < 1e-8,
        "largest first": bool((np.diff(values) <= 1e-12).all()),
        "largest loading is positive": bool((v[np.abs(v).argmax(axis=0), np.arange(len(values))] > 0).all()),
        "no larger direction is left": np.linalg.eigvalsh(cov)[::-1][len(values) - 1] <= values[-1] + 1e-8,
        "variance of scores": np.abs(np.array([spread[f"v{k}"] for k in range(len(values))]) - values).max() < 1e-8,
    }
    return spark.createDataFrame([(name, bool(ok)) for name, ok in checks.items()], "`check` string, ok boolean")


@query("pca_variance")
def pca_variance(spark, folder):
    """Explained share per component, measured on the projected rows."""
    scaled, fitted = _components(spark, folder)
    names = [f"PC{i + 1}" for i in range(len(fitted.sign))]
    spread = fitted.transform(scaled, "features").agg(*[F.var_pop(n).alias(n) for n in names])
    width = len(fitted.loadings)
    shares = spread.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("component"), (F.col(n) / width).alias("variance_share")) for n in names])))
    return tidy(shares)


# --- Training, scoring ----------------------------------------------------------------------------------------------

def _closed_form(spark, folder):
    table = _split_table(spark, folder)
    return table, models.fit_gaussian(table.where("split = 'train'"), FEATURES)


@query("flagship_train_eval_gate")
def flagship(spark, folder):
    return tidy(training.train_eval_gate(src.large_order(spark, folder), KEY, FEATURES, P.TrainingParams()))


@query("noise_gate")
def noise_gate(spark, folder):
    """The flagship flow on a label that the features say nothing about."""
    return tidy(training.train_eval_gate(src.noise_orders(spark, folder), KEY, FEATURES, P.TrainingParams()))


@query("toxic_gate")
def toxic_gate(spark, folder):
    """The flagship flow on a rare label of documents."""
    return tidy(training.train_eval_gate(
        src.toxic_docs(spark, folder), "doc_id", list(src.DOCUMENT_FEATURES), P.TrainingParams()))


@query("forest_checks")
def forest_checks(spark, folder):
    """What must hold for a forest's scores: the test part's keys, shares between 0 and 1, a class that follows the share, the
    same scores again on other partitions, and an order of the rows that is far better than chance."""
    table = _split_table(spark, folder)
    train, test = store.materialize(table.where("split = 'train'"), "train"), table.where("split = 'test'")
    fit = lambda df: models.forest_scores(models.fit_forest(df, KEY, FEATURES, n_estimators=10, max_depth=5), test, [KEY, "label"])
    one, two = store.materialize(fit(train), "forest"), fit(train.repartition(3, "label"))
    both = one.join(two.select(KEY, F.col("probability").alias("again")), KEY)
    p = F.col("probability")
    found = both.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((p >= 0) & (p <= 1)).alias("shares"),
        F.bool_and((F.col("prediction") == 1) == (p > 0.5)).alias("classes"), F.max(F.abs(p - F.col("again"))).alias("moved"))
    area = evaluate.roc_auc(one)
    return found.crossJoin(area).select(  # one row each
        F.col("n"), "shares", "classes", (F.col("moved") == 0).alias("repeatable"), (F.col("roc_auc") > 0.8).alias("orders_rows"))


@query("forest_train_score")
def forest_train_score(spark, folder):
    table = _split_table(spark, folder)
    params = P.ENVIRONMENTS["staging"]
    model = models.fit_forest(table.where("split = 'train'"), KEY, FEATURES, n_estimators=params.n_estimators,
                              max_depth=params.max_depth)
    return tidy(models.forest_scores(model, table.where("split = 'test'"), [KEY, "label"]))


@query("training_flow_forest")
def training_flow_forest(spark, folder):
    """The whole flow with a forest and staging parameters: its report rows."""
    return tidy(training.training_flow(src.large_order(spark, folder), KEY, FEATURES, P.ENVIRONMENTS["staging"]).report)


@query("env_params")
def env_params(spark, folder):
    joined = environments.with_parameters(reg.model_versions(spark, folder).select("model", "number", "environment"))
    return tidy(joined.select(
        "model", "number", "environment", "test_size", F.col("n_estimators").cast("int").alias("n_estimators"),
        F.col("max_depth").cast("int").alias("max_depth"), "min_accuracy", "min_precision", "min_recall",
        "enable_resampling", "imbalance_threshold", "enable_pca", "enable_governance"))


@query("batch_score")
def batch_score(spark, folder):
    table, model = _closed_form(spark, folder)
    return tidy(scoring.score(model, table, [KEY]))


@query("score_with_id")
def score_with_id(spark, folder):
    table, model = _closed_form(spark, folder)
    return tidy(scoring.score_with_id(model, table, KEY))


def _two_models(spark, folder):
    """Champion and challenger: the same model fitted on two hash halves of the orders."""
    table = store.materialize(src.large_order(spark, folder), "labelled")
    first = key_hash(KEY, "half") < "8"
    return table, [models.fit_gaussian(table.where(part), FEATURES) for part in (first, ~first)]


def _pair(spark, folder):
    """Both scoring every order, as two tables."""
    table, fitted = _two_models(spark, folder)
    return comparison.scored_pair(table, [KEY, "n_lines"], *fitted)


@query("score_by_stage")
def score_by_stage(spark, folder):
    first, second = _pair(spark, folder)
    return tidy(first.unionByName(second).drop("n_lines"))


@query("score_stages")
def score_stages(spark, folder):
    """Two stored versions, scored by stage: staging, production, and a third model's newest for want of a stage."""
    table, (first, second) = _two_models(spark, folder)
    paths = [bundles.save_bundle(bundles.Bundle(tuple(FEATURES), m), spark, work_folder(spark, "bundle")) for m in (first, second)]
    versions = spark.createDataFrame(
        [("orders", 1, "staging", paths[0]), ("orders", 2, "production", paths[1]), ("fresh", 1, None, paths[0])],
        "model string, number int, stage string, bundle string")
    parts = [bundles.score_stage(table, versions, model, stage, [KEY], fall_back=model == "fresh")
             for model, stage in (("orders", "staging"), ("orders", "production"), ("fresh", "production"))]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2].withColumn("model_stage", F.lit("fallback"))))


@query("model_round_trip")
def model_round_trip(spark, folder):
    """Forest scores before and after saving and loading the model."""
    table = _split_table(spark, folder)
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    fitted = models.fit_forest(train, KEY, FEATURES, n_estimators=10, max_depth=5)
    loaded = store.load_model(store.save_model(fitted, spark, "forest"))
    before, after = (models.forest_scores(m, test, [KEY]) for m in (fitted, loaded))
    return compare.align(before, after, KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max("probability_diff").alias("max_probability_diff"))


@query("coefficient_round_trip")
def coefficient_round_trip(spark, folder):
    table, model = _closed_form(spark, folder)
    stored = store.materialize(model.table(spark), "coefficients")
    return tidy(scoring.score(models.GaussianModel.from_table(stored, FEATURES), table.where("split = 'test'"), [KEY]))


def _labelled_requests(requests):
    """All requests, parsed and stored, with a rule for the harmless class."""
    parsed = req.parse_requests(requests)
    labelled = parsed.withColumn("label", (F.col("mean_radius") + F.col("worst_radius") + F.col("worst_texture")
                                           < 14.0 + 16.0 + 25.0).cast("int"))
    return store.materialize(labelled, "requests")


def _request_model(spark, folder):
    """A model for requests, fitted on all of them."""
    return models.fit_gaussian(_labelled_requests(_requests(spark, folder)), list(P.REQUEST_DEFAULTS))


def _flat_answers(answers: DataFrame) -> DataFrame:
    return tidy(answers.select(
        "event_id", "patient_id", "prediction", "probability", "risk_level", "model_version",
        F.col("explanation.top_risk_factors").alias("top_risk_factors"),
        F.col("explanation.protective_factors").alias("protective_factors")))


@query("stream_score")
def stream_score(spark, folder):
    model = _request_model(spark, folder)
    bodies = req.request_bodies(req.stream_events(spark, folder))
    output = work_folder(spark, "answers")
    stream_scoring.start_scoring(bodies, lambda: (model, 7), output, work_folder(spark, "state")).awaitTermination()
    return _flat_answers(spark.read.parquet(output))


# --- Evaluation and gates -------------------------------------------------------------------------------------------

def _test_scores(spark, folder):
    table, model = _closed_form(spark, folder)
    return scoring.score(model, table.where("split = 'test'"), [KEY, "label", "n_lines"])


@query("binary_metrics")
def binary_metrics(spark, folder):
    return tidy(evaluate.binary_metrics(_test_scores(spark, folder)))


@query("binary_metrics_by_segment")
def binary_metrics_by_segment(spark, folder):
    return tidy(evaluate.binary_metrics(_test_scores(spark, folder), by=["n_lines"]))


@query("roc_auc_exact")
def roc_auc_exact(spark, folder):
    return tidy(evaluate.roc_auc(_test_scores(spark, folder)), 9)


@query("roc_auc_by_segment")
def roc_auc_by_segment(spark, folder):
    return tidy(evaluate.roc_auc(_order_scores(spark, folder), by=["model", "quarter"]))


@query("five_metrics_by_segment")
def five_metrics_by_segment(spark, folder):
    return tidy(evaluate.evaluate(_order_scores(spark, folder), by=["model"]))


@query("step_gate")
def step_gate(spark, folder):
    return tidy(gates.apply_gate(reg.model_versions(spark, folder), reg.version_metrics(spark, folder), P.STEP_GATE))


@query("performance_rows")
def performance_rows(spark, folder):
    rows = evaluate.performance_rows(reg.version_metrics(spark, folder), P.STEP_GATE.minimum, gates.VERSION)
    return tidy(rows)


@query("overall_decision")
def overall_decision(spark, folder):
    rows = evaluate.performance_rows(reg.version_metrics(spark, folder), P.STEP_GATE.minimum, gates.VERSION)
    return gates.overall_decision(rows, gates.VERSION)


@query("after_run_decision")
def after_run_decision(spark, folder):
    rows = evaluate.performance_rows(reg.version_metrics(spark, folder), P.STEP_GATE.minimum, gates.VERSION)
    return gates.after_run_decision(rows, _versions(spark, folder), reg.flow_runs(reg.step_runs(spark, folder)))


@query("metric_status")
def metric_status(spark, folder):
    return tidy(gates.metric_status(
        reg.model_versions(spark, folder), reg.version_metrics(spark, folder), P.STAGE_GATES["production"]))


# --- Champion and challenger ----------------------------------------------------------------------------------------

def _aligned(spark, folder):
    return compare.align(*_pair(spark, folder), KEY, ["n_lines"])


@query("aligned_predictions")
def aligned_predictions(spark, folder):
    return tidy(_aligned(spark, folder).drop("n_lines"))


@query("alignment_counts")
def alignment_counts(spark, folder):
    """One side lacks some keys and repeats others."""
    champion, challenger = _pair(spark, folder)
    h = key_hash(KEY, "gap")
    fewer = challenger.where(h >= "20")
    return compare.alignment_counts(champion, fewer.unionByName(fewer.where(h >= "f0")), KEY)


@query("comparison_metrics")
def comparison_metrics(spark, folder):
    return tidy(compare.comparison(_aligned(spark, folder), 1, 2))


@query("comparison_one_pass")
def comparison_one_pass(spark, folder):
    """The comparison flow: both models in one projection of the table."""
    table, fitted = _two_models(spark, folder)
    return tidy(comparison.compare_models(table, KEY, *fitted))


@query("comparison_by_segment")
def comparison_by_segment(spark, folder):
    summary = compare.comparison(_aligned(spark, folder), by=["n_lines"])
    return tidy(summary.withColumn("recommendation", compare.recommendation()))


@query("recommendation")
def recommendation(spark, folder):
    summary = compare.comparison(_aligned(spark, folder), 1, 2)
    return summary.select("champion_version", "challenger_version", compare.recommendation().alias("recommendation"))


@query("disagreements")
def disagreements(spark, folder):
    return tidy(compare.disagreements(_aligned(spark, folder), KEY).drop("n_lines"))


@query("top_disagreements")
def top_disagreements(spark, folder):
    return tidy(compare.disagreements(_aligned(spark, folder), KEY, 20).drop("n_lines"))


# --- Registry -------------------------------------------------------------------------------------------------------

def _versions(spark, folder):
    return store.materialize(reg.model_versions(spark, folder), "versions")


@query("version_lookup")
def version_lookup(spark, folder):
    versions = _versions(spark, folder)
    models_ = versions.select("model").distinct()
    h = key_hash("model", "ask")
    wanted = models_.select(
        "model",
        F.when(h < "60", 1 + F.length("model") % 30).alias("version"),
        F.when(h < "30", "staging").when(h.between("60", "80"), "latest").when(h.between("80", "b0"), "production")
        .when(h.between("b0", "d0"), "staging").alias("from_stage"))
    return registry.look_up(wanted, versions, reg.version_metrics(spark, folder))


@query("latest_with_metrics")
def latest_with_metrics(spark, folder):
    return registry.latest_with_metrics(reg.model_versions(spark, folder), reg.version_metrics(spark, folder))


@query("latest_staging_trained")
def latest_staging_trained(spark, folder):
    return registry.latest_trained_in(reg.model_versions(spark, folder))


@query("comparison_pair")
def comparison_pair(spark, folder):
    return registry.comparison_pair(_versions(spark, folder))


def _gated(spark, folder, gate):
    return tidy(gates.apply_gate(reg.model_versions(spark, folder), reg.version_metrics(spark, folder), gate))


@query("promotion_gate")
def promotion_gate(spark, folder):
    versions = _versions(spark, folder)
    metrics = store.materialize(reg.version_metrics(spark, folder), "metrics")
    verdicts = [gates.apply_gate(versions, metrics, g) for g in P.STAGE_GATES.values()]
    return tidy(verdicts[0].unionByName(verdicts[1]).unionByName(verdicts[2]))


@query("cross_gate")
def cross_gate(spark, folder):
    return _gated(spark, folder, gates.gate_for_workspace("enterprise-production"))


@query("lenient_gate")
def lenient_gate(spark, folder):
    return _gated(spark, folder, P.LENIENT_GATE)


@query("stage_occupancy")
def stage_occupancy(spark, folder):
    versions = _versions(spark, folder)
    return registry.occupancy(versions, versions, "staging")


def _promoted(spark, folder):
    """All entries after the newest measured version of each model was promoted to staging."""
    versions = _versions(spark, folder)
    events = store.materialize(reg.promotion_events(spark, folder, versions), "events")
    best = store.materialize(
        registry.latest_with_metrics(versions, reg.version_metrics(spark, folder)).select("model", "number"), "best")
    added = registry.promote(best, versions, events, "staging", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    return events.unionByName(added)


@query("promotion_flow")
def promotion_flow(spark, folder):
    """Every version asks for production, once by the rules and once with force: the decisions, and what is appended."""
    versions = _versions(spark, folder)
    metrics = store.materialize(reg.version_metrics(spark, folder), "metrics")
    events = store.materialize(reg.promotion_events(spark, folder, versions), "events")
    # Every third number is asked for, of which a model's newest is forced; one number does not exist.
    wanted = versions.where("number % 3 = 0").select("model", F.col("number").alias("version"), F.lit(None).cast("string").alias("from_stage"))
    wanted = wanted.unionByName(versions.select("model", F.lit(1000).alias("version"), F.lit(None).cast("string").alias("from_stage")).distinct())
    ts = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    decided, _ = registry.promotion_flow(wanted, versions, metrics, events, "production", ts)
    newest = wanted.where("version < 1000").groupBy("model", "from_stage").agg(F.max("version").alias("version"))
    _, added = registry.promotion_flow(newest, versions, metrics, events, "production", ts, force=True)
    shown = decided.select("model", F.coalesce("number", F.lit(1000)).alias("number"), F.lit("decision").alias("row"), F.col("decision").alias("what"),
                           F.coalesce("gate", F.lit("none")).alias("gate"))
    return shown.unionByName(added.select("model", "number", F.lit("entry").alias("row"),
                                          F.concat_ws(" > ", "from_stage", "to_stage").alias("what"), F.col("seq").cast("string").alias("gate")))


@query("current_stage")
def current_stage(spark, folder):
    return tidy(registry.current_stage(_promoted(spark, folder)).drop("since"))


@query("chain_append")
def chain_append(spark, folder):
    chains = registry.chains(_promoted(spark, folder))
    steps = F.transform("chain", lambda e: F.concat(
        e["seq"].cast("string"), F.lit(":"), e["from_stage"], F.lit(">"), e["to_stage"]))
    return tidy(chains.select("model", "number", F.size("chain").alias("entries"), steps.alias("chain")))


@query("stage_history")
def stage_history(spark, folder):
    events = store.materialize(reg.promotion_events(spark, folder), "events")
    return tidy(registry.stage_history(events))


@query("last_actions")
def last_actions(spark, folder):
    """The chains, with an import at the end of those that reached production."""
    events = store.materialize(reg.promotion_events(spark, folder), "events")
    arrived = events.where("to_stage = 'production'").join(registry.next_seq(events), ["model", "number"]).withColumns(
        {"action": F.lit("imported"), "seq": F.col("next_seq")}).drop("next_seq")
    return registry.last_actions(events.unionByName(arrived))


@query("rollback_target")
def rollback_target(spark, folder):
    return registry.rollback_targets(_versions(spark, folder)).select("model", "current", "target")


@query("previous_version")
def previous_version(spark, folder):
    return registry.rollback_targets(_versions(spark, folder)).select("model", "current", "previous")


@query("rollback_plan")
def rollback_plan(spark, folder):
    return registry.rollback_plan(_versions(spark, folder), reason="drift")


@query("rollback_events")
def rollback_events(spark, folder):
    versions = _versions(spark, folder)
    events = store.materialize(reg.promotion_events(spark, folder, versions), "events")
    plan = registry.rollback_plan(versions)
    added = registry.rollback_events(plan, versions, events, F.lit("2024-06-02 00:00:00").cast("timestamp_ntz"))
    return tidy(added.select("model", "number", "seq", "workspace", "from_stage", "to_stage", "ts"))


def _broken_manifests(spark, folder):
    """Manifest texts, most of which lack one required field by hash."""
    fault = key_hash(F.concat("model", F.lit("/"), F.col("number").cast("string")), "fault")
    faulty = lambda low, high, column: F.when((fault >= low) & (fault < high), None).otherwise(column)
    m = F.col("parsed")
    source = m["source"].withField("workspace", faulty("60", "70", m["source"]["workspace"])).withField(
        "model_version", faulty("70", "80", m["source"]["model_version"]))
    arts = m["artifacts"].withField("model", faulty("80", "90", m["artifacts"]["model"]))
    broken = F.struct(
        faulty("10", "20", m["model_name"]).alias("model_name"),
        m["export_timestamp"].alias("export_timestamp"),
        faulty("20", "30", m["export_path"]).alias("export_path"),
        faulty("30", "40", source).alias("source"),
        m["metrics"].alias("metrics"),
        faulty("40", "50", arts).alias("artifacts"),
        faulty("50", "60", m["promotion_chain"]).alias("promotion_chain"),
    )
    return manifests.manifest_json(_exported(spark, folder).select("model", "number", broken.alias("parsed")))


@query("manifest_validation")
def manifest_validation(spark, folder):
    return manifests.validate_manifests(_broken_manifests(spark, folder))


@query("export_manifest")
def export_manifest(spark, folder):
    return _manifest_columns(_exported(spark, folder).select("parsed.*"))


@query("import_record")
def import_record(spark, folder):
    run = F.when(F.col("number") % 3 != 0, F.concat(F.lit("import-"), F.col("model"), F.lit("-"), F.col("number").cast("string")))
    records = manifests.import_manifests(
        _exported(spark, folder), P.PRODUCTION_WORKSPACE, "production", IMPORTED_AT, run,
        F.sha1(F.concat("model", F.lit("/"), F.col("number").cast("string"))))
    last = F.element_at("promotion_chain", -1)
    return tidy(records.select(
        "model", F.col("source.model_version").alias("number"), "status", "source_workspace", "dest_stage", "has_scaler",
        F.size("promotion_chain").alias("entries"), last["action"].alias("last_action"),
        last["to_workspace"].alias("to_workspace"), last["import_run_url"].alias("import_run_url"),
        F.col("source.training_run_url").alias("training_run_url"), "imported_at", "git_commit"))


@query("back_links")
def back_links(spark, folder):
    versions = _versions(spark, folder)
    exported = versions.where("stage = 'staging'")
    arrived = versions.where(F.col("stage").isNotNull()).select(
        "model", F.col("number").alias("source_version"),
        F.md5(F.concat(F.lit("imported/"), "version_id")).alias("new_version_id"))
    return manifests.back_links(exported, arrived, P.PRODUCTION_WORKSPACE, "production", IMPORTED_AT).select(
        "model", "number", "promoted_to.*")


# --- Lineage, runs ---------------------------------------------------------------------------------------------------

@query("lineage_trace")
def lineage_trace(spark, folder):
    versions = _versions(spark, folder)
    steps = reg.step_runs(spark, folder)
    served = _order_scores(spark, folder).select("model", "quarter")
    predictions = served.join(versions.select("model", "quarter", "number"), ["model", "quarter"])
    trace = lineage.lineage_trace(versions, reg.flow_runs(steps), reg.artifacts(steps), predictions)
    return tidy(trace.drop("start_time", "end_time"))


@query("run_metrics")
def run_metrics(spark, folder):
    steps = reg.step_runs(spark, folder)
    outputs = reg.artifacts(steps)
    share = lambda salt: F.conv(F.substring(key_hash("step_run_id", salt), 1, 2), 16, 10).cast("int") / F.lit(256.0)
    entry = lambda metric, salt: F.struct(F.lit(metric).alias("metric"), share(salt).alias("value"))
    measured = steps.where("step = 'evaluate_model'").select(
        "step_run_id", F.inline(F.array(entry("accuracy", "acc"), entry("recall", "rec"))))
    return tidy(lineage.run_metrics(
        reg.flow_runs(steps), outputs, measured, _versions(spark, folder), reg.version_metrics(spark, folder)))


@query("step_durations")
def step_durations(spark, folder):
    return tidy(lineage.step_durations(reg.step_runs(spark, folder)))


@query("governance_sweep")
def governance_sweep(spark, folder):
    return tidy(policy.governance_sweep(reg.model_versions(spark, folder)))


@query("run_alert_rows")
def run_alert_rows(spark, folder):
    steps = reg.step_runs(spark, folder)
    runs = lineage.run_alerts(reg.flow_runs(steps), steps, _versions(spark, folder))
    of_steps = lineage.step_alerts(steps).select(
        F.concat(F.lit("step/"), F.col("step_run_id").cast("string")).alias("subject"), "status", "message")
    return of_steps.unionByName(runs.select(F.concat(F.lit("run/"), "run_id").alias("subject"), "status", "message"))


# --- Described in the guides only ------------------------------------------------------------------------------------

def _drift_pair(spark, folder):
    """The first half of the month against the second, plain and with a shifted value."""
    events = src.table(spark, folder, "events").select(
        "value", F.hour("ts").cast("double").alias("hour"), "event_type",
        (F.dayofmonth("ts") > 15).alias("is_current"))
    return events, events.withColumn("value", F.when(F.col("is_current"), F.col("value") * 1.5).otherwise(F.col("value")))


@query("drift_columns")
def drift_columns(spark, folder):
    plain, shifted = _drift_pair(spark, folder)
    rows = lambda df, name: drift.drift_columns(df, ["value", "hour"], ["event_type"]).withColumn("pair", F.lit(name))
    return tidy(rows(plain, "plain").unionByName(rows(shifted, "shifted")))


@query("drift_score")
def drift_score(spark, folder):
    plain, shifted = _drift_pair(spark, folder)
    rows = lambda df, name: drift.drift_columns(df, ["value", "hour"], ["event_type"]).withColumn("pair", F.lit(name))
    return tidy(drift.drift_score(rows(plain, "plain").unionByName(rows(shifted, "shifted")), by=["pair"]))


@query("retrain_trigger")
def retrain_trigger(spark, folder):
    _, shifted = _drift_pair(spark, folder)
    return tidy(drift.retrain_trigger(drift.drift_score(drift.drift_columns(shifted, ["value"]))))


def _audit_log(spark, folder):
    return audit.audit_log(reg.promotion_events(spark, folder), reg.flow_runs(reg.step_runs(spark, folder)))


@query("audit_export")
def audit_export(spark, folder):
    """Written by date, so that the export reads only the partitions of its range."""
    path = store.write_table(_audit_log(spark, folder), work_folder(spark, "audit"), ("month",))
    log = spark.read.parquet(path)
    rows = audit.audit_export(log, "2001-01-01", "2024-01-20", ["model_promotion", "pipeline_run"], P.PROJECT)
    return tidy(rows.drop("month"))


@query("retention")
def retention(spark, folder):
    return tidy(audit.retained(_audit_log(spark, folder), "2024-04-10").drop("month"))


@query("keep_last_runs")
def keep_last_runs(spark, folder):
    return audit.keep_last_runs(reg.flow_runs(reg.step_runs(spark, folder))).select("flow", "run_id", "rank", "status")


@query("approval_gate")
def approval_gate(spark, folder):
    """Approvals from the events: the user approves a version, in a role that goes with the user."""
    role = F.when(F.col("user_id") % 3 == 0, "data-scientist").when(F.col("user_id") % 3 == 1, "ml-engineer").otherwise("viewer")
    approvals = src.table(spark, folder, "events").select(
        F.concat(F.lit("model_"), (F.col("event_id") % 25).cast("string")).alias("model"),
        (1 + F.floor(F.col("event_id") / 25) % 27).cast("int").alias("number"),
        F.col("user_id").alias("approver"), role.alias("role"))
    return audit.approval_gate(approvals, "production")


@query("prediction_log_sample")
def prediction_log_sample(spark, folder):
    scores = _order_scores(spark, folder).select(KEY, "model", "prediction", "probability")
    return tidy(audit.sampled_log(scores, KEY))


@query("stream_monitor")
def stream_monitor(spark, folder):
    events, source = req.read_events(spark, folder), work_folder(spark, "events")
    events.repartitionByRange(4, "ts").write.parquet(source)
    # The stream has ended: a closing row lets its last windows be written.
    events.limit(0).unionByName(monitor.closing_rows(events), allowMissingColumns=True).write.mode("append").parquet(source)
    scores = req.stream_events(spark, source, "*.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).cast("int").alias("prediction"),
        (F.col("value") / (F.col("value") + 50)).alias("probability"))
    output = work_folder(spark, "windows")
    monitor.start_monitor(monitor.window_summary(scores), output, work_folder(spark, "state")).awaitTermination()
    return tidy(spark.read.parquet(output))


@query("last_failed_run")
def last_failed_run(spark, folder):
    steps = reg.step_runs(spark, folder)
    return tidy(lineage.last_failed_run(reg.flow_runs(steps), steps))
