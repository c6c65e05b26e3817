"""From a trained run to scores: bundle it, register it as a version, gate and promote it, and score with what holds a stage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.operators.evaluate import metric_rows
from tollgate.operators.registry import current_stage, promotion_flow, rollback_events, rollback_plan
from tollgate.plans.training import TrainedRun
from tollgate.session import work_folder
from tollgate.sources.artifacts import materialize
from tollgate.sources.bundles import Bundle, new_version, save_bundle
from tollgate.sources.registry_log import RegistryLog


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_TEXT, _NUMBER, _TIME = T.StringType(), T.IntegerType(), T.TimestampNTZType()
VERSIONS = _schema(model=_TEXT, number=_NUMBER, stage=_TEXT, environment=_TEXT, bundle=_TEXT, training_run_id=_TEXT, created=_TIME)
METRICS = _schema(model=_TEXT, number=_NUMBER, metric=_TEXT, value=T.DoubleType())
ENTRIES = _schema(model=_TEXT, number=_NUMBER, seq=_NUMBER, action=_TEXT, workspace=_TEXT, from_stage=_TEXT, to_stage=_TEXT, ts=_TIME,
                  training_run_url=_TEXT)


@dataclass(frozen=True)
class Registry:
    """Versions (without their stage), their metrics, and the log that says which stage each is in."""

    versions: DataFrame
    metrics: DataFrame
    log: RegistryLog

    def staged(self) -> DataFrame:
        """The versions with the stage their last stored entry set."""
        now = current_stage(self.log.entries()).select("model", "number", "stage")
        return self.versions.drop("stage").join(now, ["model", "number"], "left").select(*VERSIONS.names)


def register(registry: Registry, model: str, bundle: Bundle, metrics: DataFrame, environment: str, ts: Column, run_id: str) -> tuple[Registry, int]:
    """Store the bundle and add the model's next version, in no stage, with its metrics (one row, a column for each).

    Returns the registry with both, and the version's number.
    """
    spark = registry.versions.sparkSession
    path = save_bundle(bundle, spark, work_folder(spark, f"bundle-{model}"))
    row = materialize(new_version(registry.versions, model, path, environment, ts, run_id).select(*VERSIONS.names), "version")
    number = row.first()["number"]
    values = metric_rows(metrics).select(F.lit(model).alias("model"), F.lit(number).alias("number"), "metric", "value")
    added = Registry(materialize(registry.versions.unionByName(row), "versions"),
                     materialize(registry.metrics.unionByName(values), "metrics"), registry.log)
    return added, number


def register_run(registry: Registry, model: str, run: TrainedRun, features: Sequence[str], ts: Column, run_id: str) -> tuple[Registry, int]:
    """The version of a training flow: its forest with the scaler and components it was trained behind."""
    bundle = Bundle(tuple(features), run.model, run.scaler, run.components)
    return register(registry, model, bundle, run.metrics, run.environment, ts, run_id)


def promote_version(registry: Registry, model: str, number: int, target: str, ts: Column, force: bool = False,
                    skip_validation: bool = False) -> str:
    """Gate the version and move it to the stage, stored as one operation. Returns the decision."""
    operation = f"{target}_{model}_{number}_{len(registry.log.operations())}"
    spark = registry.versions.sparkSession
    wanted = spark.createDataFrame([(model, number, None)], "model string, version int, from_stage string")
    decisions, added = promotion_flow(wanted, registry.staged(), registry.metrics, registry.log.entries(), target, ts, force, skip_validation)
    decision = decisions.first()["decision"]
    if decision == "promoted":
        registry.log.append(added, operation)
    return decision


def roll_back(registry: Registry, ts: Column, reason: str) -> DataFrame:
    """Plan the rollback of every model and store its two changes as one operation. Returns the plan."""
    staged = registry.staged()
    plan = materialize(rollback_plan(staged, reason=reason), "rollback")
    if not plan.where("outcome = 'planned'").isEmpty():
        registry.log.append(rollback_events(plan, staged, registry.log.entries(), ts), f"rollback_{len(registry.log.operations())}")
    return plan
