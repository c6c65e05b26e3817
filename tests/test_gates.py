"""Gate policies: limits, the four meanings of a missing metric, status and decisions."""

import pytest

from tollgate import params as P
from tollgate.operators import gates, policy
from tollgate.functions.scalars import reasons, risk_tier, round_probability

CASES = {
    "sample": dict(accuracy=0.85, precision=0.82, recall=0.88, f1_score=0.85, roc_auc=0.90),
    "poor": dict(accuracy=0.55, precision=0.50, recall=0.60, f1_score=0.54, roc_auc=0.58),
    "borderline": dict(accuracy=0.7, precision=0.7, recall=0.7),
    "below": dict(accuracy=0.699, precision=0.7, recall=0.7),
    "incomplete": dict(accuracy=0.9),
    "staging only": dict(accuracy=0.75, precision=0.72, recall=0.78),
    "none": {},
}


@pytest.fixture(scope="module")
def registry(spark):
    versions = spark.createDataFrame([(c, 1) for c in CASES], "model string, number int")
    rows = [(c, 1, m, v) for c, metrics in CASES.items() for m, v in metrics.items()]
    return versions, spark.createDataFrame(rows, "model string, number int, metric string, value double")


def verdicts(registry, gate):
    return {r.model: r for r in gates.apply_gate(*registry, gate).collect()}


@pytest.mark.parametrize("stage, passing", [
    ("staging", {"sample", "borderline", "staging only"}), ("production", {"sample"}),
    ("archived", {"sample", "poor", "borderline", "below", "staging only"})])
def test_promotion_gate(registry, stage, passing):
    got = verdicts(registry, P.STAGE_GATES[stage])
    assert {m for m, r in got.items() if r.outcome == "PASS"} == passing
    assert {m for m, r in got.items() if r.outcome == "ERROR"} == {"incomplete", "none"}
    assert list(got["incomplete"].failures) == ["missing precision", "missing recall"]


def test_failure_texts(registry):
    got = verdicts(registry, P.STAGE_GATES["staging"])
    assert list(got["below"].failures) == ["accuracy: 0.699 < 0.700 (required)"]
    assert list(verdicts(registry, P.STEP_GATE)["poor"].failures) == [
        "Accuracy 0.550 < 0.700", "Precision 0.500 < 0.700", "Recall 0.600 < 0.700"]


def test_missing_metric_in_each_gate(registry):
    step = verdicts(registry, P.STEP_GATE)["incomplete"]
    assert (step.outcome, list(step.failures)) == ("FAIL", ["Precision 0.000 < 0.700", "Recall 0.000 < 0.700"])
    cross = verdicts(registry, gates.gate_for_workspace("enterprise-production"))["incomplete"]
    assert list(cross.failures) == ["precision: missing (required >= 0.8)", "recall: missing (required >= 0.8)"]
    assert verdicts(registry, P.LENIENT_GATE)["incomplete"].outcome == "PASS"
    assert {r.outcome for r in verdicts(registry, gates.gate_for_workspace("elsewhere")).values()} == {"PASS"}


def test_nan_passes_unless_strict(spark):
    versions = spark.createDataFrame([("m", 1)], "model string, number int")
    metrics = spark.createDataFrame([("m", 1, m, float("nan")) for m in P.GATED_METRICS],
                                    "model string, number int, metric string, value double")
    assert gates.apply_gate(versions, metrics, P.STEP_GATE).first().outcome == "PASS"
    assert gates.apply_gate(versions, metrics, P.STEP_GATE, strict_nan=True).first().outcome == "FAIL"


def test_require_gate_raises_with_every_failure(spark):
    df = spark.createDataFrame([(0.6, 0.9, 0.5)], "accuracy double, precision double, recall double")
    with pytest.raises(gates.GateError, match="Accuracy 0.600 < 0.700; Recall 0.500 < 0.700"):
        gates.require_gate(df, P.STEP_GATE)


def test_metric_status(registry):
    rows = gates.metric_status(*registry, P.STAGE_GATES["production"]).collect()
    got = {(r.model, r.metric): (r.status, r.version_passes) for r in rows}
    assert got["incomplete", "accuracy"] == ("PASS", False)
    assert got["incomplete", "recall"] == ("MISSING", False)
    assert got["sample", "recall"] == ("PASS", True)
    assert got["staging only", "recall"] == ("FAIL", False)


@pytest.mark.parametrize("p, tier", [(0.7, "MEDIUM"), (0.7000001, "LOW"), (0.4, "HIGH"), (0.4000001, "MEDIUM"), (0.0, "HIGH")])
def test_risk_tier_limits(spark, p, tier):
    assert spark.createDataFrame([(p,)], "p double").select(risk_tier("p").alias("t")).first().t == tier


def test_reasons_are_ordered_and_may_be_empty(spark):
    df = spark.createDataFrame([(16.0, 0.2, 18.0, 0.2), (15.0, 0.1, 18.0, 0.15)],
                               "mean_radius double, mean_concavity double, worst_radius double, worst_concave_points double")
    got = [r.x for r in df.select(reasons(P.RISK_REASONS).alias("x")).collect()]
    assert got == [["Large mean radius", "High concavity", "High worst concave points"], []]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.12345,), (0.12355,), (0.98765432,)], "p double")
    assert [r.x for r in df.select(round_probability("p").alias("x")).collect()] == [0.1234, 0.1236, 0.9877]


def test_policies(spark):
    df = spark.createDataFrame([
        ("fraud_detection_1", 1, ["use_case:x", "owner_team:y"], "abc"), ("other", 2, ["owner_team"], ""), ("churn_prediction", 3, None, None)],
        "model string, number int, tags array<string>, git_commit string")
    got = {r.number: r for r in policy.governance_sweep(df).collect()}
    assert (list(got[1].missing_prefixes), got[1].name_ok, got[1].commit_ok, got[1].warnings) == ([], True, True, 0)
    assert (list(got[2].missing_prefixes), got[2].name_ok, got[2].commit_ok, got[2].warnings) == (["use_case:", "owner_team:"], False, False, 2)
    assert (list(got[3].missing_prefixes), got[3].commit_ok) == (["use_case:", "owner_team:"], False)
