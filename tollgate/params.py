"""Policies, thresholds, word lists and message formats, stated once."""

from __future__ import annotations

from dataclasses import dataclass, replace

SEED = 42

# --- Fixed values: metrics -----------------------------------------------------------------------------------------
METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
GATED_METRICS = ("accuracy", "precision", "recall")

# --- Fixed values: decision limits ---------------------------------------------------------------------------------
MIN_ROWS = 100
MAX_MISSING_FRACTION = 0.1
TEST_ROWS_DIVISOR = 5
IMBALANCE_THRESHOLD = 0.3
SMOTE_NEIGHBOURS = 5
TIER_LOW_ABOVE = 0.7
TIER_MEDIUM_ABOVE = 0.4
SAFE_AGREEMENT = 0.95
SAFE_DIFFERENCE = 0.05
REVIEW_AGREEMENT = 0.85
DRIFT_ALERT = 0.3
INFERENCE_SAMPLE_ROWS = 200
LISTING_ROWS = 5
KEEP_LAST_RUNS = 100
RETENTION_DAYS = {"standard": 90, "enterprise": 2555}


@dataclass(frozen=True)
class Gate:
    """Minimum per metric, and what a missing metric means: 'zero', 'error', 'fail' or 'skip'."""

    name: str
    minimum: dict
    on_missing: str


def _all_metrics(minimum: float) -> dict:
    return {metric: minimum for metric in GATED_METRICS}


# --- Fixed values: gate policies -----------------------------------------------------------------------------------
STEP_GATE = Gate("step", _all_metrics(0.7), "zero")
STAGE_GATES = {
    "staging": Gate("staging", _all_metrics(0.7), "error"),
    "production": Gate("production", _all_metrics(0.8), "error"),
    "archived": Gate("archived", {}, "error"),
}
WORKSPACE_GATES = {
    "enterprise-staging": Gate("enterprise-staging", _all_metrics(0.7), "fail"),
    "enterprise-production": Gate("enterprise-production", _all_metrics(0.8), "fail"),
}
LENIENT_GATE = Gate("lenient-production", _all_metrics(0.8), "skip")


@dataclass(frozen=True)
class TrainingParams:
    """Parameters of one training run; the defaults are the code defaults."""

    environment: str = "local"
    test_size: float = 0.2
    n_estimators: int = 100
    max_depth: int = 10
    min_accuracy: float = 0.7
    min_precision: float = 0.7
    min_recall: float = 0.7
    enable_resampling: bool = False
    imbalance_threshold: float = IMBALANCE_THRESHOLD
    enable_pca: bool = False
    max_features_for_pca: int = 50
    pca_components: int = 30
    enable_governance: bool = True
    seed: int = SEED
    forest_partitions: int = 32  # rows are put in order in so many parts, whatever the cluster

    def step_gate(self) -> Gate:
        return replace(
            STEP_GATE,
            minimum={"accuracy": self.min_accuracy, "precision": self.min_precision, "recall": self.min_recall},
        )


# --- Fixed values: parameters by environment -----------------------------------------------------------------------
ENVIRONMENTS = {
    "local": TrainingParams(environment="local", n_estimators=70, max_depth=5, enable_governance=False),
    "staging": TrainingParams(environment="staging", n_estimators=50, max_depth=5, enable_resampling=True),
    "production": TrainingParams(environment="production", min_accuracy=0.8, enable_resampling=True),
}

# --- Fixed values: request record, in model order, with the default of each field ----------------------------------
REQUEST_DEFAULTS = {
    "mean_radius": 14.0,
    "mean_texture": 19.0,
    "mean_perimeter": 92.0,
    "mean_area": 655.0,
    "mean_smoothness": 0.096,
    "mean_compactness": 0.104,
    "mean_concavity": 0.088,
    "mean_concave_points": 0.049,
    "mean_symmetry": 0.181,
    "mean_fractal_dimension": 0.063,
    "radius_error": 0.4,
    "texture_error": 1.2,
    "perimeter_error": 2.9,
    "area_error": 40.0,
    "smoothness_error": 0.007,
    "compactness_error": 0.025,
    "concavity_error": 0.032,
    "concave_points_error": 0.012,
    "symmetry_error": 0.021,
    "fractal_dimension_error": 0.004,
    "worst_radius": 16.0,
    "worst_texture": 25.0,
    "worst_perimeter": 107.0,
    "worst_area": 881.0,
    "worst_smoothness": 0.132,
    "worst_compactness": 0.254,
    "worst_concavity": 0.272,
    "worst_concave_points": 0.115,
    "worst_symmetry": 0.290,
    "worst_fractal_dimension": 0.084,
}

# --- Fixed values: reason rules (field, comparison, limit, text), in report order -----------------------------------
RISK_REASONS = (
    ("mean_radius", ">", 15.0, "Large mean radius"),
    ("mean_concavity", ">", 0.1, "High concavity"),
    ("worst_radius", ">", 18.0, "Large worst radius"),
    ("worst_concave_points", ">", 0.15, "High worst concave points"),
)
PROTECTIVE_REASONS = (("mean_smoothness", "<", 0.09, "Low smoothness"),)

# --- Fixed values: tag, name and manifest policies -----------------------------------------------------------------
REQUIRED_TAG_PREFIXES = ("use_case:", "owner_team:")
MODEL_NAME_PREFIXES = ("breast_cancer", "fraud_detection", "churn_prediction")
MANIFEST_FIELDS = ("model_name", "export_path", "source", "artifacts", "promotion_chain")
MANIFEST_SOURCE_FIELDS = ("workspace", "model_version")

# --- Fixed values: workspaces, project and approval rules -----------------------------------------------------------
DEV_WORKSPACE = "enterprise-dev-staging"
PRODUCTION_WORKSPACE = "enterprise-production"
PROJECT = "cancer-detection"
APPROVAL_ROLES = {
    "staging": ("data-scientist", "ml-engineer", "platform-admin"),
    "production": ("ml-engineer", "platform-admin"),
}
MIN_APPROVERS = {"staging": 0, "production": 2}

# --- Fixed values: text formats ------------------------------------------------------------------------------------
RUN_URL = "{base}/workspaces/{workspace}/projects/{project}/runs/{id}?tab=overview"
VERSION_URL = "{base}/workspaces/{workspace}/projects/{project}/model-versions/{id}?tab=overview"
DEFAULT_REASON = "Not specified"
RECOMMENDATIONS = {"safe": "SAFE TO PROMOTE", "review": "REVIEW RECOMMENDED", "caution": "CAUTION"}

# Address of the registry that audit links point to; set it to your own.
REGISTRY_ADDRESS = "https://registry.example.com"
