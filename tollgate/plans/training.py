"""The whole training flow as functions from table to table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.operators.balance import balance
from tollgate.operators.evaluate import evaluate, metric_rows, performance_rows
from tollgate.operators.features import Components, Scaler, fit_components, fit_scaler, use_components
from tollgate.operators.gates import gate_row, overall_decision, require_gate
from tollgate.operators.models import fit_forest, fit_gaussian, forest_scores
from tollgate.operators.quality import quality_measures, report_rows, require_quality, split_min_rows
from tollgate.operators.scoring import score
from tollgate.operators.split import fit_split
from tollgate.sources.artifacts import materialize


@dataclass
class TrainedRun:
    """What a run leaves behind."""

    model: object
    scaler: Scaler
    components: Components | None
    scored_test: DataFrame
    metrics: DataFrame  # one row
    report: DataFrame | None
    decision: DataFrame | None  # one row: whether no check of the report failed
    environment: str


def split_table(df: DataFrame, key: str, label: str = "label", test_size: float = 0.2, seed: int = P.SEED) -> DataFrame:
    """Write the feature table once and split it; every later step reads it with only the columns it needs.

    The split itself is a comparison per row, so it is not stored.
    """
    table = materialize(df, "features")
    return fit_split(table, key, label, test_size, seed).assign(table)


def train_eval_gate(df: DataFrame, key: str, features: Sequence[str], params: P.TrainingParams, label: str = "label") -> DataFrame:
    """Split, fit the closed-form model, score the test part: one row with the metrics and the gate's verdict."""
    table = split_table(df, key, label, params.test_size, params.seed)
    model = fit_gaussian(table.where("split = 'train'"), features, label)
    scored = score(model, table.where("split = 'test'"), [key, label])
    return gate_row(evaluate(scored, label=label), params.step_gate())


def training_flow(df: DataFrame, key: str, features: Sequence[str], params: P.TrainingParams, label: str = "label") -> TrainedRun:
    """Load, check, balance, scale, reduce, train a forest, evaluate, gate and report.

    Checks see the train features before balancing; the scaler is fitted after it, so its statistics include synthetic
    rows; the report's train section shows the balanced table. With governance on, a failed check raises before
    anything is returned.
    """
    features = list(features)
    table = split_table(df, key, label, params.test_size, params.seed)
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    if params.enable_governance:
        require_quality(train, features)
    train = balance(train, key, features, label, params.enable_resampling, params.imbalance_threshold, params.seed)
    train = materialize(train, "balanced")
    scaler = fit_scaler(train, features)
    train_x, test_x = scaler.transform(train), scaler.transform(test).withColumn(key, F.col(key).cast("string"))
    components, used = None, features
    if use_components(len(features), params.enable_pca, params.max_features_for_pca):
        vectors = [d.withColumn("__x", F.array(*features)) for d in (train_x, test_x)]
        components = fit_components(vectors[0], "__x", len(features), params.pca_components)
        train_x, test_x = (components.transform(v, "__x", [key, label]) for v in vectors)
        used = [f"PC{i + 1}" for i in range(len(components.sign))]
    model = fit_forest(train_x, key, used, label, params.n_estimators, params.max_depth, params.seed, params.forest_partitions)
    scored = materialize(forest_scores(model, test_x, [key, label]), "scored_test")
    metrics = evaluate(scored, label=label)
    report = decision = None
    if params.enable_governance:
        require_gate(metrics, params.step_gate())
        report = materialize(training_report(train, test_x, used, features, metrics, params), "report")
        decision = overall_decision(report)
    return TrainedRun(model, scaler, components, scored, metrics, report, decision, params.environment)


def training_report(train: DataFrame, test: DataFrame, test_columns: Sequence[str], train_columns: Sequence[str],
                    metrics: DataFrame, params: P.TrainingParams) -> DataFrame:
    """One row per check of the train table, the test table and the metrics."""
    parts = [
        report_rows(quality_measures(train, train_columns), F.lit("train"), F.lit(P.MIN_ROWS)),
        report_rows(quality_measures(test, test_columns), F.lit("test"), F.lit(P.MIN_ROWS // P.TEST_ROWS_DIVISOR)),
        performance_report(metrics, params),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def performance_report(metrics: DataFrame, params: P.TrainingParams) -> DataFrame:
    rows = performance_rows(metric_rows(metrics), params.step_gate().minimum)
    return rows.select(F.lit("performance").alias("dataset"), F.col("metric").alias("check"), "threshold", "actual", "result")


def split_report(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """The quality rows of both parts of a split table in one pass."""
    measures = quality_measures(table, features, ["split"])
    return report_rows(measures, F.col("split"), split_min_rows())
