"""Registry tables derived from the order and event tables, in the shape the registry operators read.

A model is a customer nation, a version is an order quarter of that nation, and its metrics come from scoring the
quarter's orders. A run is one user's day of events and its steps are the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate import params as P
from tollgate.functions.scalars import key_hash, run_url
from tollgate.operators.evaluate import evaluate
from tollgate.sources.requests import read_events
from tollgate.sources.tables import LARGE_ORDER, ORDER_KEY, order_features, table

# Weights of the fixed score that plays the part of every version's model.
SCORE_LINES, SCORE_QUANTITY, SCORE_CENTRE = 0.75, 0.09, 5.9

STEP_OF_EVENT = {
    "view": "load_data",
    "signup": "engineer_features",
    "click": "train_model",
    "purchase": "evaluate_model",
    "error": "validate_data_quality",
}


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with model, quarter, label, prediction and probability."""
    orders = order_features(spark, folder, "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    z = F.col("n_lines") * SCORE_LINES + F.col("avg_quantity") * SCORE_QUANTITY - SCORE_CENTRE
    prefix = (
        F.when(F.col("c_nationkey") % 4 == 0, "breast_cancer_")
        .when(F.col("c_nationkey") % 4 == 1, "fraud_detection_")
        .when(F.col("c_nationkey") % 4 == 2, "churn_prediction_")
        .otherwise("pricing_")
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        ORDER_KEY,
        F.concat(prefix, F.col("c_nationkey").cast("string")).alias("model"),
        F.trunc("o_orderdate", "quarter").alias("quarter"),
        "o_orderdate",
        (F.col("price_cents") > LARGE_ORDER * 100).cast("int").alias("label"),
        (z > 0).cast("int").alias("prediction"),
        (1 / (1 + F.exp(-z))).alias("probability"),
    )


def _version_numbers(segments: DataFrame) -> DataFrame:
    """Number the quarters of each model, then leave out one in nine so that the numbers have gaps.

    The window sees one row per model and quarter, as many as the calendar has.
    """
    order = Window.partitionBy("model").orderBy("quarter")
    numbered = segments.withColumn("number", F.row_number().over(order))
    return numbered.where(key_hash(F.concat("model", F.lit("/"), F.col("number").cast("string")), "gap") >= "1c")


def _version_key() -> Column:
    return F.concat(F.col("model"), F.lit("/"), F.col("number").cast("string"))


def model_versions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model and version number, with stage, environment, tags, commit, dates and training run."""
    segments = (
        scored_orders(spark, folder)
        .groupBy("model", "quarter")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.min("o_orderdate").alias("created"),
             F.max("o_orderdate").alias("updated"))
    )
    numbered = _version_numbers(segments)
    newest = numbered.groupBy("model").agg(F.max("number").alias("newest"))
    h = lambda salt: key_hash(_version_key(), salt)
    # The production version of a model is its newest, the one before, or the one before that; some models have none.
    production = F.col("newest") - F.when(key_hash("model", "p") < "55", 0).when(key_hash("model", "p") < "aa", 1).otherwise(2)
    versions = numbered.join(newest, "model").withColumn("production", production)
    stage = (
        F.when((F.col("number") == F.col("production")) & (key_hash("model", "none") >= "20"), "production")
        .when(F.col("number") == F.col("production") + 1, "staging")
        .when((F.col("number") < F.col("production")) & (h("a") < "80"), "archived")
    )
    environment = F.when(h("e") < "55", "local").when(h("e") < "aa", "staging").when(h("e") < "e0", "production")
    tags = F.array_compact(F.array(
        F.lit("classification"),
        F.when(h("t1") < "d0", F.concat(F.lit("use_case:"), F.col("model"))),
        F.when(h("t2") < "b0", F.lit("owner_team:ml-platform")),
    ))
    day = F.lpad((1 + F.col("number") % 30).cast("string"), 2, "0")
    user = F.regexp_extract("model", "([0-9]+)$", 1)
    run = F.when(h("r") < "e0", F.concat(user, F.lit("/2024-01-"), day))
    return versions.select(
        "model",
        "number",
        F.md5(_version_key()).alias("version_id"),
        stage.alias("stage"),
        environment.alias("environment"),
        tags.alias("tags"),
        F.when(h("c") < "c0", F.sha1(_version_key())).alias("git_commit"),
        "created",
        "updated",
        run.alias("training_run_id"),
        (h("s") < "e0").alias("has_scaler"),
        "quarter",
        "n_orders",
    )


def version_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Long metric table. About one version in seven has no recall; an undefined area under the curve has no row."""
    scored = scored_orders(spark, folder)
    by = ("model", "quarter")
    numbered = _version_numbers(evaluate(scored, by=by))
    lost = key_hash(_version_key(), "recall") < "24"
    wide = numbered.withColumn("recall", F.when(~lost, F.col("recall")))
    return (
        wide.unpivot(["model", "number"], list(P.METRICS), "metric", "value")
        .where(F.col("value").isNotNull())
    )


def promotion_events(spark: SparkSession, folder: str, versions: DataFrame | None = None) -> DataFrame:
    """The stage changes that led to each version's stage, numbered from 0 within the version."""
    versions = model_versions(spark, folder) if versions is None else versions
    def move(before: str, after: str, days: int) -> Column:
        return F.struct(F.lit(before).alias("from_stage"), F.lit(after).alias("to_stage"), F.lit(days).alias("days"))
    path = {
        "staging": [("none", "staging", 1)],
        "production": [("none", "staging", 1), ("staging", "production", 8)],
        "archived": [("none", "staging", 1), ("staging", "production", 8), ("production", "archived", 30)],
    }
    moves = F.when(F.lit(False), F.array(move("", "", 0)))
    for stage, steps in path.items():
        moves = moves.when(F.col("stage") == stage, F.array(*[move(*step) for step in steps]))
    exploded = versions.where(F.col("stage").isNotNull()).select(
        "model", "number", "updated", "training_run_id", F.posexplode(moves).alias("seq", "move"))
    workspace = F.lit(P.DEV_WORKSPACE)
    return exploded.select(
        "model",
        "number",
        "seq",
        F.lit("promoted").alias("action"),
        workspace.alias("workspace"),
        F.col("move.from_stage").alias("from_stage"),
        F.col("move.to_stage").alias("to_stage"),
        (F.col("updated") + F.make_dt_interval(days=F.col("move.days"))).alias("ts"),
        run_url(workspace, F.col("training_run_id")).alias("training_run_url"),
    )


def step_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per step of a run. The end comes from the event's value in seconds; one in eight has none."""
    events = read_events(spark, folder)
    step = F.lit(None).cast("string")
    for kind, name in STEP_OF_EVENT.items():
        step = F.when(F.col("event_type") == kind, name).otherwise(step)
    failed = F.col("event_type") == "error"
    millis = F.rint(F.col("value") * 1000).cast("bigint")
    ended = F.col("ts") + F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)"))
    return events.select(
        F.col("event_id").alias("step_run_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.when(F.col("user_id") % 4 == 0, "batch_inference").when(F.col("user_id") % 4 == 1, "champion_challenger")
        .otherwise("training").alias("flow"),
        step.alias("step"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.col("ts").alias("start_time"),
        F.when(key_hash("event_id", "open") >= "20", ended).alias("end_time"),
        F.when(failed, F.concat(F.lit("ValueError: code "), F.get_json_object("props", "$.k"))).alias("error"),
        F.concat(F.lit("user_"), (F.col("user_id") % 7).cast("string")).alias("user"),
    )


def flow_runs(steps: DataFrame) -> DataFrame:
    """One row per run, from its steps. The sums combine on the map side, so a run of any length is one row per task."""
    commit = F.when(key_hash("run_id", "commit") < "c0", F.sha1(F.col("run_id")))
    return (
        steps.groupBy("run_id", "flow", "user")
        .agg(
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.max(F.col("status") == "failed").alias("any_failed"),
            F.count(F.lit(1)).alias("n_steps"),
        )
        .select(
            "run_id", "flow", "user", "start_time", "end_time", "n_steps",
            F.when(F.col("any_failed"), "failed").otherwise("completed").alias("status"),
            commit.alias("commit"),
        )
    )


def artifacts(steps: DataFrame) -> DataFrame:
    """Outputs of completed steps: two from loading, the metrics from most evaluations, one from every other step."""
    output = lambda name: F.struct(F.lit(name).alias("output"))
    names = (
        F.when(F.col("step") == "load_data", F.array(output("X_train"), output("y_train")))
        .when((F.col("step") == "evaluate_model") & (key_hash("step_run_id", "out") < "c0"), F.array(output("eval_Metrics")))
        .when(F.col("step") == "evaluate_model", F.array(output("log")))
        .otherwise(F.array(output("data")))
    )
    exploded = steps.where(F.col("status") == "completed").select(
        "run_id", "step", "step_run_id", F.explode(names).alias("o"))
    return exploded.select(
        "run_id", "step", "step_run_id", F.col("o.output").alias("output"),
        F.concat(F.lit("artifacts/"), "run_id", F.lit("/"), "step", F.lit("/"), "o.output", F.lit("/"),
                 F.col("step_run_id").cast("string")).alias("uri"),
    )
