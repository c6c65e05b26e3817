"""The SQL each query is checked against, written from the operators' meaning and run by DuckDB on the same tables.

Shared parts are common table expressions; ``sql(parts, body)`` puts those that are needed in front of a body.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

KEY = "o_orderkey"
FEATURES = ["o_totalprice", "n_lines", "avg_discount", "avg_quantity", "avg_tax"]
# The request record's fields and defaults.
REQUEST_DEFAULTS = [
    ("mean_radius", 14.0), ("mean_texture", 19.0), ("mean_perimeter", 92.0), ("mean_area", 655.0),
    ("mean_smoothness", 0.096), ("mean_compactness", 0.104), ("mean_concavity", 0.088), ("mean_concave_points", 0.049),
    ("mean_symmetry", 0.181), ("mean_fractal_dimension", 0.063), ("radius_error", 0.4), ("texture_error", 1.2),
    ("perimeter_error", 2.9), ("area_error", 40.0), ("smoothness_error", 0.007), ("compactness_error", 0.025),
    ("concavity_error", 0.032), ("concave_points_error", 0.012), ("symmetry_error", 0.021),
    ("fractal_dimension_error", 0.004), ("worst_radius", 16.0), ("worst_texture", 25.0), ("worst_perimeter", 107.0),
    ("worst_area", 881.0), ("worst_smoothness", 0.132), ("worst_compactness", 0.254), ("worst_concavity", 0.272),
    ("worst_concave_points", 0.115), ("worst_symmetry", 0.290), ("worst_fractal_dimension", 0.084),
]
REQUEST_FIELDS = [name for name, _ in REQUEST_DEFAULTS]


def h(key: str, salt: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{salt}')"


def r(expression: str, places: int = 6) -> str:
    return f"round_even(CAST({expression} AS DOUBLE), {places})"


def cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


VERSION = "(model || '/' || CAST(number AS VARCHAR))"
URL = "'https://registry.example.com/workspaces/{workspace}/projects/cancer-detection/{kind}/' || {id} || '?tab=overview'"


def run_link(run: str, workspace: str = "enterprise-dev-staging") -> str:
    return URL.format(workspace=workspace, kind="runs", id=run)


def version_link(version: str, workspace: str = "enterprise-dev-staging") -> str:
    return URL.format(workspace=workspace, kind="model-versions", id=version)


# --- Shared parts -----------------------------------------------------------------------------------------------------

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], body: str) -> None:
    PARTS[name] = (needs, body)


def sql(needs: str, body: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][0]:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    ctes = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body


part("lines", (), f"""
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines,
         CAST(sum({cents('l_discount')}) AS DOUBLE) / 100e0 / count(*) AS avg_discount,
         CAST(sum({cents('l_quantity')}) AS DOUBLE) / 100e0 / count(*) AS avg_quantity,
         CAST(sum({cents('l_tax')}) AS DOUBLE) / 100e0 / count(*) AS avg_tax,
         CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS price_cents
  FROM lineitem GROUP BY l_orderkey""")


def split_parts(name: str, key: str) -> None:
    """Exact stratified split: rank in hash order within the class, against the class's share of the test rows."""
    part(f"{name}_sizes", (name,), f"""
  SELECT label, n, base + CASE WHEN place <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS train_rows FROM (
    SELECT *, row_number() OVER (ORDER BY base - n * n_train / total, label) AS place FROM (
      SELECT *, floor(n * n_train / total) AS base FROM (
        SELECT *, total - ceil(0.2e0 * total) AS n_train FROM (
          SELECT label, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM {name} GROUP BY label))))""")
    part(f"{name}_split", (name, f"{name}_sizes"), f"""
  SELECT t.*, CASE WHEN row_number() OVER (PARTITION BY t.label ORDER BY {h(key, '42')}, {key}) <= s.n - s.train_rows
              THEN 'test' ELSE 'train' END AS split
  FROM {name} t JOIN {name}_sizes s ON t.label = s.label""")


for _name, _limit in (("large", 250000), ("rare", 300000)):
    part(_name, ("lines",), f"""
  SELECT o_orderkey, {', '.join(FEATURES)}, CASE WHEN price_cents > {_limit} * 100 THEN 1 ELSE 0 END AS label
  FROM orders JOIN lines ON o_orderkey = l_orderkey""")
    split_parts(_name, KEY)
part("noise", ("lines",), f"""
  SELECT o_orderkey, {', '.join(FEATURES)}, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM orders JOIN lines ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O')""")
split_parts("noise", KEY)


def gaussian(name: str, train: str, features: list[str], key: str, score: str, extra: str = "", label: str = "label") -> None:
    """Parts ``<name>_fit`` and ``<name>``: Gaussian naive Bayes fitted on one query's rows and applied to another's."""
    moments = ", ".join(f"avg({f}) FILTER (WHERE {label} = {c}) AS m{c}_{f}, var_pop({f}) FILTER (WHERE {label} = {c}) AS v{c}_{f}"
                        for f in features for c in (0, 1))
    part(f"{name}_fit", (), f"SELECT {moments}, count(*) FILTER (WHERE {label} = 0) AS n0, count(*) FILTER (WHERE {label} = 1) AS n1 FROM ({train})")
    z = "ln(CAST(n1 AS DOUBLE) / n0)" + "".join(
        f" - 0.5e0 * ln(v1_{f} / v0_{f}) - ({f} - m1_{f}) * ({f} - m1_{f}) / (2 * v1_{f}) + ({f} - m0_{f}) * ({f} - m0_{f}) / (2 * v0_{f})"
        for f in features)
    part(name, (f"{name}_fit",), f"""
  SELECT {key}{extra}, CASE WHEN z > 0 THEN 1 ELSE 0 END AS prediction, 1 / (1 + exp(-z)) AS probability
  FROM (SELECT s.*, {z} AS z FROM ({score}) s, {name}_fit)""")


gaussian("nb", "SELECT * FROM large_split WHERE split = 'train'", FEATURES, KEY, "SELECT * FROM large_split",
         ", split, label, n_lines")
gaussian("nb_first", f"SELECT * FROM large WHERE {h(KEY, 'half')} < '8'", FEATURES, KEY, "SELECT * FROM large", ", n_lines")
gaussian("nb_second", f"SELECT * FROM large WHERE NOT {h(KEY, 'half')} < '8'", FEATURES, KEY, "SELECT * FROM large", ", n_lines")


def confusion(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""
  SELECT {head}count(*) AS n, CAST(tp + tn AS DOUBLE) / nullif(count(*), 0) AS accuracy,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
         coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1_score
  FROM (SELECT {head} count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
               count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
               count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM {source} {group})
  GROUP BY {head} tp, fp, fn, tn""".replace("count(*) AS n, CAST", "tp + fp + fn + tn AS n, CAST").replace(
        "nullif(count(*), 0)", "nullif(tp + fp + fn + tn, 0)")


def auc(source: str, by: str = "") -> str:
    """Mid-rank form: the rank sum of the positives, ties at their middle rank."""
    over = f"PARTITION BY {by} " if by else ""
    head, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
  SELECT {head}(sum(mid) FILTER (WHERE label = 1) - p * (p + 1) / 2) / nullif(p * n, 0) AS roc_auc FROM (
    SELECT {head}label, rank() OVER ({over}ORDER BY probability) + (count(*) OVER ({over.rstrip() + ',' if over else 'PARTITION BY'} probability) - 1) / 2e0 AS mid,
           CAST(count(*) FILTER (WHERE label = 1) OVER ({over}) AS DOUBLE) AS p,
           CAST(count(*) FILTER (WHERE label = 0) OVER ({over}) AS DOUBLE) AS n
    FROM {source}) GROUP BY {head}p, n"""


part("scored", ("lines",), """
  SELECT o_orderkey, model, quarter, o_orderdate, label, CASE WHEN z > 0 THEN 1 ELSE 0 END AS prediction, 1 / (1 + exp(-z)) AS probability
  FROM (SELECT o_orderkey, o_orderdate, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
          CASE c_nationkey % 4 WHEN 0 THEN 'breast_cancer_' WHEN 1 THEN 'fraud_detection_' WHEN 2 THEN 'churn_prediction_' ELSE 'pricing_' END
            || CAST(c_nationkey AS VARCHAR) AS model,
          CASE WHEN price_cents > 25000000 THEN 1 ELSE 0 END AS label,
          n_lines * 0.75e0 + avg_quantity * 0.09e0 - 5.9e0 AS z
        FROM orders JOIN lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)""")
part("numbered", ("scored",), f"""
  SELECT * FROM (SELECT model, quarter, count(*) AS n_orders, min(o_orderdate) AS created, max(o_orderdate) AS updated,
    CAST(row_number() OVER (PARTITION BY model ORDER BY quarter) AS INTEGER) AS number FROM scored GROUP BY model, quarter)
  WHERE {h(VERSION, 'gap')} >= '1c'""")
part("versions", ("numbered",), f"""
  SELECT model, number, quarter, md5({VERSION}) AS version_id,
    CASE WHEN number = production AND {h('model', 'none')} >= '20' THEN 'production'
         WHEN number = production + 1 THEN 'staging'
         WHEN number < production AND {h(VERSION, 'a')} < '80' THEN 'archived' END AS stage,
    CASE WHEN {h(VERSION, 'e')} < '55' THEN 'local' WHEN {h(VERSION, 'e')} < 'aa' THEN 'staging'
         WHEN {h(VERSION, 'e')} < 'e0' THEN 'production' END AS environment,
    {h(VERSION, 't1')} < 'd0' AS has_use_case, {h(VERSION, 't2')} < 'b0' AS has_owner,
    {h(VERSION, 'c')} < 'c0' AS has_commit, created, updated,
    CASE WHEN {h(VERSION, 'r')} < 'e0'
         THEN regexp_extract(model, '([0-9]+)$', 1) || '/2024-01-' || lpad(CAST(1 + number % 30 AS VARCHAR), 2, '0') END AS training_run_id,
    {h(VERSION, 's')} < 'e0' AS has_scaler
  FROM (SELECT *, max(number) OVER (PARTITION BY model)
          - CASE WHEN {h('model', 'p')} < '55' THEN 0 WHEN {h('model', 'p')} < 'aa' THEN 1 ELSE 2 END AS production
        FROM numbered)""")
part("segment_counts", ("scored",), confusion("scored", "model, quarter"))
part("segment_auc", ("scored",), auc("scored", "model, quarter"))
part("metrics_wide", ("segment_counts", "segment_auc", "numbered"), f"""
  SELECT v.model, v.number, accuracy, precision, CASE WHEN {h('(v.model || chr(47) || CAST(v.number AS VARCHAR))', 'recall')} >= '24' THEN recall END AS recall,
         f1_score, roc_auc
  FROM numbered v JOIN segment_counts USING (model, quarter) JOIN segment_auc USING (model, quarter)""")
part("metrics", ("metrics_wide",), """
  SELECT model, number, 'accuracy' AS metric, accuracy AS value FROM metrics_wide WHERE accuracy IS NOT NULL
  UNION ALL SELECT model, number, 'precision', precision FROM metrics_wide WHERE precision IS NOT NULL
  UNION ALL SELECT model, number, 'recall', recall FROM metrics_wide WHERE recall IS NOT NULL
  UNION ALL SELECT model, number, 'f1_score', f1_score FROM metrics_wide WHERE f1_score IS NOT NULL
  UNION ALL SELECT model, number, 'roc_auc', roc_auc FROM metrics_wide WHERE roc_auc IS NOT NULL""")
part("moves", (), """
  SELECT * FROM (VALUES ('staging', 0, 'none', 'staging', 1), ('production', 0, 'none', 'staging', 1),
    ('production', 1, 'staging', 'production', 8), ('archived', 0, 'none', 'staging', 1),
    ('archived', 1, 'staging', 'production', 8), ('archived', 2, 'production', 'archived', 30))
    AS m(stage, seq, from_stage, to_stage, days)""")
part("promotions", ("versions", "moves"), """
  SELECT model, number, seq, from_stage, to_stage, updated + to_days(CAST(days AS INTEGER)) AS ts, training_run_id
  FROM versions JOIN moves USING (stage)""")
part("steps", (), f"""
  SELECT event_id AS step_run_id, CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS run_id,
    CASE user_id % 4 WHEN 0 THEN 'batch_inference' WHEN 1 THEN 'champion_challenger' ELSE 'training' END AS flow,
    CASE event_type WHEN 'view' THEN 'load_data' WHEN 'signup' THEN 'engineer_features' WHEN 'click' THEN 'train_model'
         WHEN 'purchase' THEN 'evaluate_model' ELSE 'validate_data_quality' END AS step,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS start_time,
    CASE WHEN {h('event_id', 'open')} >= '20' THEN ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) END AS end_time,
    CASE WHEN event_type = 'error' THEN 'ValueError: code ' || json_extract_string(props, '$.k') END AS error,
    'user_' || CAST(user_id % 7 AS VARCHAR) AS "user"
  FROM events""")
part("runs", ("steps",), f"""
  SELECT run_id, flow, "user", min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n_steps,
    CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN {h('run_id', 'commit')} < 'c0' THEN sha1(run_id) END AS "commit"
  FROM steps GROUP BY run_id, flow, "user\"""")
part("outputs", ("steps",), f"""
  SELECT run_id, step, step_run_id, output,
    'artifacts/' || run_id || '/' || step || '/' || output || '/' || CAST(step_run_id AS VARCHAR) AS uri
  FROM (SELECT *, unnest(CASE WHEN step = 'load_data' THEN ['X_train', 'y_train']
     WHEN step = 'evaluate_model' AND {h('step_run_id', 'out')} < 'c0' THEN ['eval_Metrics']
     WHEN step = 'evaluate_model' THEN ['log'] ELSE ['data'] END) AS output FROM steps WHERE status = 'completed')""")
part("request_bytes", (), f"SELECT event_id, {h('event_id', 'a')} || {h('event_id', 'b')} AS digits FROM events")
_byte = lambda i: f"CAST('0x' || substr(digits, {2 * i + 1}, 2) AS INTEGER)"
part("requests", ("request_bytes",), "SELECT event_id, " + ", ".join(
    f"CASE WHEN {_byte(i)} >= 51 THEN {d}e0 * (0.5e0 + {_byte(i)} / 256e0) ELSE {d}e0 END AS {n}"
    for i, (n, d) in enumerate(REQUEST_DEFAULTS)) + f", CASE WHEN {_byte(30)} < 32 THEN 'age' ELSE '' END AS unknown_fields FROM request_bytes")
part("dirty", (), """
  SELECT l.* EXCLUDE (c, copy) REPLACE (CASE WHEN substr(md5(c), 1, 2) < '1a' THEN NULL ELSE l_discount END AS l_discount,
                      CASE WHEN substr(md5(c), 3, 2) < '0d' THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS l_tax)
  FROM (SELECT *, unnest(CASE WHEN substr(md5(c), 5, 2) < '05' THEN [0, 1] ELSE [0] END) AS copy FROM (
    SELECT *, concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity) AS BIGINT),
                        CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem)) l""")
DIRTY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]
MISSING = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in DIRTY[4:8] else ''})" for c in DIRTY)
part("dirty_measures", ("dirty",), f"""
  SELECT count(*) AS n_rows, {MISSING} AS missing_cells,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows FROM dirty""")


def docs_share(characters: str) -> str:
    return (f"coalesce((CAST(length(text) AS DOUBLE) - length(regexp_replace(text, '[{characters}]', '', 'g'))) "
            f"/ nullif(CAST(length(text) AS DOUBLE), 0), 0)")


part("toxic_docs", (), f"""
  SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, {docs_share('0-9')} AS digit_frac, {docs_share(' ')} AS space_frac,
    {docs_share(chr(10))} AS nl_frac, {docs_share('A-Z')} AS upper_frac, {docs_share('.,;:!?')} AS punct_frac, toxic AS label
  FROM documents JOIN labels USING (doc_id)""")


# --- Sources, sinks ---------------------------------------------------------------------------------------------------

def rounded(columns: list[str], places: int = 6) -> str:
    return ", ".join(f"{r(c, places)} AS {c}" for c in columns)


LABELLED = f"o_orderkey, {rounded(FEATURES)}, label"
ORACLES["load_labelled"] = sql("large", f"SELECT {LABELLED} FROM large")
ORACLES["artifact_round_trip"] = ORACLES["load_labelled"]
ORACLES["load_noise_labels"] = sql("lines", f"""
SELECT o_orderkey, {rounded(FEATURES)}, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
FROM orders JOIN lines ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O')""")
ORACLES["load_toxic_documents"] = sql("toxic_docs", f"""
SELECT doc_id, {rounded(['n_chars', 'digit_frac', 'space_frac', 'nl_frac', 'upper_frac', 'punct_frac'])}, label FROM toxic_docs""")
ORACLES["inference_sample"] = sql("large", f"""
SELECT {LABELLED} FROM (SELECT * FROM large ORDER BY {h(KEY, '42')}, o_orderkey LIMIT 200)""")

FOLDER = ("'exchange/exports/' || model || '/enterprise-dev-staging_to_production/' || CAST(number AS VARCHAR) || '/2024-06-01T12-00-00'")
ORACLES["export_manifest"] = sql("versions metrics promotions", f"""
SELECT v.model, v.number, {FOLDER} AS export_path, 'enterprise-dev-staging' AS workspace, coalesce(stage, 'latest') AS stage,
  {version_link('version_id')} AS model_version_url, {run_link('training_run_id')} AS training_run_url,
  {stamp('created')} AS created_at, {FOLDER} || '/model' AS model_path,
  CASE WHEN has_scaler THEN {FOLDER} || '/scaler' END AS scaler_path,
  coalesce(m.shown, '') AS metrics,
  coalesce(c.shown || '; ', '') || 'exported>' || coalesce(stage, 'latest') || '>-' AS chain
FROM versions v
LEFT JOIN (SELECT model, number, string_agg(metric || '=' || printf('%.6f', {r('value')}), '; ' ORDER BY metric) AS shown
           FROM metrics GROUP BY 1, 2) m USING (model, number)
LEFT JOIN (SELECT model, number, string_agg('promoted>' || from_stage || '>' || to_stage, '; ' ORDER BY seq) AS shown
           FROM promotions GROUP BY 1, 2) c USING (model, number)""")
ORACLES["manifest_round_trip"] = ORACLES["export_manifest"]


def report(dataset: str, minimum: int, source: str) -> str:
    values = " OR ".join(f"{f} IS NULL OR isnan({f})" for f in FEATURES)
    missing = " + ".join(f"count(*) FILTER (WHERE {f} IS NULL OR isnan({f}))" for f in FEATURES)
    del values
    return f"""
SELECT '{dataset}' AS dataset, u.c AS "check", CASE u.c WHEN 'minimum_rows' THEN {minimum}e0 WHEN 'missing_values' THEN 0.1e0 END AS threshold,
  {r("CASE u.c WHEN 'minimum_rows' THEN n WHEN 'missing_values' THEN miss / (n * 5e0) ELSE dup END")} AS actual,
  CASE u.c WHEN 'minimum_rows' THEN CASE WHEN n >= {minimum} THEN 'PASS' ELSE 'FAIL' END
    WHEN 'missing_values' THEN CASE WHEN miss / (n * 5e0) <= 0.1 THEN 'PASS' ELSE 'FAIL' END
    ELSE CASE WHEN dup > 0 THEN 'WARNING' ELSE 'OK' END END AS result
FROM (SELECT count(*) AS n, {missing} AS miss,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(FEATURES)} FROM {source} WHERE split = '{dataset}')) AS dup
      FROM {source} WHERE split = '{dataset}'),
     (SELECT unnest(['minimum_rows', 'missing_values', 'duplicate_rows']) AS c) u"""


QUALITY = report("train", 100, "large_split") + "\nUNION ALL" + report("test", 20, "large_split")
ORACLES["dq_report_by_split"] = sql("large_split", QUALITY)
part("test_scores", ("large_split", "nb"), "SELECT * FROM nb WHERE split = 'test'")
part("test_counts", ("test_scores",), confusion("test_scores"))
part("test_auc", ("test_scores",), auc("test_scores"))
part("test_metrics", ("test_counts", "test_auc"), "SELECT * FROM test_counts, test_auc")
ORACLES["training_report_rows"] = sql("large_split test_metrics", QUALITY + f"""
UNION ALL SELECT 'performance', metric, CASE WHEN metric IN ('accuracy', 'precision', 'recall') THEN 0.7e0 END, {r('value')},
  CASE WHEN metric NOT IN ('accuracy', 'precision', 'recall') THEN 'INFO' WHEN value >= 0.7 THEN 'PASS' ELSE 'FAIL' END
FROM (UNPIVOT (SELECT accuracy, precision, recall, f1_score, roc_auc FROM test_metrics) ON COLUMNS(*) INTO NAME metric VALUE value)""")
ORACLES["in_flow_decision"] = f"""
SELECT count(*) AS checks, count(*) FILTER (WHERE result = 'FAIL') AS failed_checks,
  CASE WHEN count(*) FILTER (WHERE result = 'FAIL') = 0 THEN 'PASSED' ELSE 'FAILED' END AS decision FROM ({ORACLES["training_report_rows"]})"""
ORACLES["registry_listing"] = sql("versions", f"""
SELECT model, number, stage, {stamp('created')} AS created, {stamp('updated')} AS updated
FROM versions ORDER BY versions.updated DESC, model, number DESC LIMIT 5""")
ORACLES["listing_by_model"] = sql("versions", """
SELECT model, number, stage, row_number() OVER (PARTITION BY model ORDER BY updated DESC, number DESC) AS place FROM versions QUALIFY place <= 5""")
ORACLES["latest_training_run"] = sql("runs", f"""
SELECT run_id, flow, status, {stamp('start_time')} AS start_time, n_steps FROM runs r
WHERE flow = 'training' ORDER BY r.start_time DESC, run_id DESC LIMIT 1""")

# --- Projections ------------------------------------------------------------------------------------------------------

_area = next(v for k, v in REQUEST_DEFAULTS if k == "worst_area")
ORACLES["request_validation"] = f"""
SELECT event_id, CASE WHEN event_id % 9 IN (0, 1, 5, 6) THEN 'body is not a JSON object' WHEN event_id % 9 IN (2, 4) THEN 'not a number: mean_radius' END AS problem,
  CASE event_id % 9 WHEN 3 THEN 20.5e0 WHEN 7 THEN 12.25e0 WHEN 8 THEN 14e0 END AS mean_radius, CASE WHEN event_id % 9 IN (3, 7, 8) THEN {_area}::DOUBLE END AS worst_area FROM events"""
ORACLES["request_defaults"] = sql("requests", f"SELECT event_id, {', '.join(REQUEST_FIELDS)}, unknown_fields FROM requests")
TIER = "CASE WHEN {p} > 0.7 THEN 'LOW' WHEN {p} > 0.4 THEN 'MEDIUM' ELSE 'HIGH' END"
RISKS = """concat_ws('; ', CASE WHEN mean_radius > 15 THEN 'Large mean radius' END, CASE WHEN mean_concavity > 0.1e0 THEN 'High concavity' END,
  CASE WHEN worst_radius > 18 THEN 'Large worst radius' END, CASE WHEN worst_concave_points > 0.15e0 THEN 'High worst concave points' END)"""
PROTECTIVE = "CASE WHEN mean_smoothness < 0.09e0 THEN 'Low smoothness' ELSE '' END"
ORACLES["risk_tier"] = sql("scored", f"SELECT o_orderkey, {TIER.format(p='probability')} AS risk_level FROM scored")
ORACLES["reason_lists"] = sql("requests", f"SELECT event_id, {RISKS} AS top_risk_factors, {PROTECTIVE} AS protective_factors FROM requests")
ORACLES["rounded_probability"] = sql("scored", f"SELECT o_orderkey, {r('probability', 4)} AS probability FROM scored")
ORACLES["short_id"] = "SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS patient_id FROM events"
ORACLES["environment_tag"] = sql("versions", "SELECT model, number, 'staging' AS environment FROM versions")
MISSING_TAGS = "concat_ws('; ', CASE WHEN NOT has_use_case THEN 'use_case:' END, CASE WHEN NOT has_owner THEN 'owner_team:' END)"
NAME_OK = "(model LIKE 'breast!_cancer%' ESCAPE '!' OR model LIKE 'fraud!_detection%' ESCAPE '!' OR model LIKE 'churn!_prediction%' ESCAPE '!')"
ORACLES["tag_policy"] = sql("versions", f"SELECT model, number, {MISSING_TAGS} AS missing_prefixes FROM versions")
ORACLES["name_policy"] = sql("versions", f"SELECT model, number, {NAME_OK} AS name_ok FROM versions")
ORACLES["commit_policy"] = sql("versions", "SELECT model, number, has_commit AS commit_ok FROM versions")
ORACLES["governance_sweep"] = sql("versions", f"""
SELECT model, number, {MISSING_TAGS} AS missing_prefixes, {NAME_OK} AS name_ok, has_commit AS commit_ok,
  CASE WHEN has_use_case AND has_owner THEN 0 ELSE 1 END + CASE WHEN {NAME_OK} THEN 0 ELSE 1 END AS warnings FROM versions""")
ORACLES["audit_urls"] = sql("versions", f"""
SELECT model, number, {version_link('version_id')} AS model_version_url, {run_link('training_run_id')} AS training_run_url FROM versions""")
ORACLES["metadata_unwrap"] = sql("versions metrics promotions", f"""
SELECT model, number, metric AS name, CAST(NULL AS VARCHAR) AS text, {r('value')} AS value FROM metrics
UNION ALL SELECT model, number, 'environment', environment, NULL FROM versions WHERE environment IS NOT NULL
UNION ALL SELECT model, number, 'environment_text', coalesce(environment, 'none'), NULL FROM versions
UNION ALL SELECT model, number, 'governed', 'true', NULL FROM versions
UNION ALL SELECT model, number, 'promotion_chain', string_agg(from_stage || '>' || to_stage, '; ' ORDER BY seq), NULL FROM promotions GROUP BY 1, 2""")
ORACLES["drop_incomplete"] = sql("dirty", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {rounded(DIRTY[4:8])} FROM dirty WHERE l_discount IS NOT NULL AND NOT isnan(l_tax)""")

# --- Data quality -----------------------------------------------------------------------------------------------------

ORACLES["dq_min_rows"] = "SELECT count(*) AS n_rows, 100 AS min_rows, count(*) >= 100 AS passed FROM supplier"
ORACLES["dq_missing_fraction"] = sql("dirty_measures", f"""
SELECT n_rows, missing_cells, {r('missing_cells / (n_rows * 11e0)')} AS missing_fraction, missing_cells / (n_rows * 11e0) <= 0.1 AS passed FROM dirty_measures""")
ORACLES["dq_duplicates"] = sql("dirty_measures", "SELECT duplicate_rows FROM dirty_measures")
ORACLES["dq_gate"] = sql("dirty_measures", f"""
SELECT n_rows, missing_cells, duplicate_rows, {r('missing_cells / (n_rows * 11e0)')} AS missing_fraction, n_rows >= 100 AS rows_pass,
  missing_cells / (n_rows * 11e0) <= 0.1 AS missing_pass, duplicate_rows > 0 AS duplicate_warning,
  CASE WHEN n_rows < 100 THEN 'min_rows' WHEN missing_cells / (n_rows * 11e0) > 0.1 THEN 'missing_fraction' END AS first_failure,
  n_rows >= 100 AND missing_cells / (n_rows * 11e0) <= 0.1 AS passed FROM dirty_measures""")
_types = dict(zip(DIRTY, ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"]))
_widths = {"int": 4, "date": 4, "float": 4}
ORACLES["column_profile"] = sql("dirty", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{_types[c]}' AS dtype, count(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in DIRTY[4:8] else ''}) AS missing_count, "
    f"{r(f'''count(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in DIRTY[4:8] else ''}) / count(*) * 100''')} AS missing_pct, "
    f"CAST({'coalesce(sum(strlen(' + c + ')), 0)' if _types[c] == 'string' else f'count({c}) * {_widths.get(_types[c], 8)}'} AS BIGINT) AS n_bytes, "
    f"count(*) AS n_rows, 11 AS n_cols FROM dirty" for c in DIRTY))
ORACLES["class_distribution"] = "SELECT toxic AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL GROUP BY toxic"
ORACLES["resample_decision"] = sql("large rare", "\nUNION ALL ".join(f"""
SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS labelled_rows, {r('min(n) / sum(n)')} AS minority_ratio,
  coalesce(min(n) / sum(n) < 0.3, false) AS resample, '{t}' AS dataset FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM {t} GROUP BY label)"""
    for t in ("large", "rare")))
ORACLES["high_risk_summary"] = sql("scored", f"""
SELECT model, count(*) AS total, count(*) FILTER (WHERE prediction = 1) AS high_risk,
  {r('count(*) FILTER (WHERE prediction = 1) / count(*) * 100')} AS high_risk_pct FROM scored GROUP BY model""")

# --- Split, balance, features -----------------------------------------------------------------------------------------

ORACLES["stratified_split"] = sql("large_split", "SELECT o_orderkey, label, split FROM large_split")
_distance = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATURES)
_u32 = lambda text, salt: f"CAST('0x' || substr({h(text, salt)}, 1, 8) AS BIGINT)"
ORACLES["smote_exact"] = sql("rare", f"""
, minority AS (SELECT *, row_number() OVER (ORDER BY {h(KEY, '42|copies')}, o_orderkey) AS place FROM rare WHERE label = 1),
sizes AS (SELECT count(*) FILTER (WHERE label = 0) - count(*) FILTER (WHERE label = 1) AS wanted, count(*) FILTER (WHERE label = 1) AS n FROM rare),
bases AS (SELECT m.*, unnest(range(0, wanted // n + CASE WHEN place <= wanted % n THEN 1 ELSE 0 END)) AS copy FROM minority m, sizes),
named AS (SELECT *, CAST(o_orderkey AS VARCHAR) || '#' || CAST(copy AS VARCHAR) AS name FROM bases),
near AS (SELECT a.o_orderkey AS base, b.*, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY {_distance}, b.o_orderkey) AS rank
  FROM minority a JOIN minority b ON a.o_orderkey <> b.o_orderkey QUALIFY rank <= 5)
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {rounded(FEATURES, 5)}, label, false AS synthetic FROM rare
UNION ALL SELECT name, {', '.join(r(f'a.{f} + {_u32("name", "42|step")} / 4294967296e0 * (b.{f} - a.{f})', 5) for f in FEATURES)}, 1, true
FROM named a JOIN near b ON a.o_orderkey = b.base AND b.rank = 1 + {_u32('name', '42|neighbour')} % 5""".replace("\n, minority", ", minority", 1))
ORACLES["scaler_stats"] = sql("large_split", "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(f'avg({f})')} AS mean, {r(f'stddev_pop({f})')} AS std, "
    f"{r(f'CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END')} AS scale FROM large_split WHERE split = 'train'" for f in FEATURES))
ORACLES["scaled_features"] = sql("large_split", f"""
SELECT o_orderkey, {', '.join(r(f'coalesce(({f} - (SELECT avg({f}) FROM large_split WHERE split = {chr(39)}train{chr(39)})) / nullif((SELECT stddev_pop({f}) FROM large_split WHERE split = {chr(39)}train{chr(39)}), 0), 0)') + f' AS {f}' for f in FEATURES)},
  label, split FROM large_split""")
ORACLES["pca_gate"] = "SELECT count(*) AS n_rows, CAST(max(len(embedding)) AS INTEGER) AS n_features, max(len(embedding)) > 50 AS use_pca FROM embeddings"

# --- Training, scoring ------------------------------------------------------------------------------------------------

def flagship(name: str, features: list[str], key: str) -> str:
    """Split, fit, score the test part, five metrics and the verdict."""
    gaussian(f"{name}_nb", f"SELECT * FROM {name}_split WHERE split = 'train'", features, key,
             f"SELECT * FROM {name}_split WHERE split = 'test'", ", label")
    part(f"{name}_counts", (), confusion(f"{name}_nb"))
    part(f"{name}_auc", (), auc(f"{name}_nb"))
    verdict = ", ".join(f"CASE WHEN {m} < 0.7 THEN '{m.capitalize()} ' || printf('%.3f', {r(m, 3)}) || ' < 0.700' END"
                        for m in ("accuracy", "precision", "recall"))
    return sql(f"{name}_split {name}_nb {name}_counts {name}_auc", f"""
SELECT {rounded(['accuracy', 'precision', 'recall', 'f1_score', 'roc_auc'])}, n, 'step' AS gate,
  CASE WHEN accuracy < 0.7 OR precision < 0.7 OR recall < 0.7 THEN 'FAIL' ELSE 'PASS' END AS outcome,
  concat_ws('; ', {verdict}) AS failures
FROM {name}_counts, {name}_auc""")


split_parts("toxic_docs", "doc_id")
ORACLES["flagship_train_eval_gate"] = flagship("large", FEATURES, KEY)
ORACLES["noise_gate"] = flagship("noise", FEATURES, KEY)
ORACLES["toxic_gate"] = flagship("toxic_docs", ["n_chars", "digit_frac", "space_frac", "nl_frac", "upper_frac", "punct_frac"], "doc_id")
ORACLES["env_params"] = sql("versions", """
SELECT model, number, v.environment, test_size, n_estimators, max_depth, min_accuracy, min_precision, min_recall, enable_resampling,
  imbalance_threshold, enable_pca, enable_governance
FROM versions v LEFT JOIN (VALUES ('local', 0.2e0, 70, 5, 0.7e0, 0.7e0, 0.7e0, false, 0.3e0, false, false),
  ('staging', 0.2e0, 50, 5, 0.7e0, 0.7e0, 0.7e0, true, 0.3e0, false, true),
  ('production', 0.2e0, 100, 10, 0.8e0, 0.7e0, 0.7e0, true, 0.3e0, false, true)) AS p(environment, test_size, n_estimators, max_depth,
  min_accuracy, min_precision, min_recall, enable_resampling, imbalance_threshold, enable_pca, enable_governance) ON v.environment = p.environment""")
ORACLES["batch_score"] = sql("large_split nb", f"SELECT o_orderkey, prediction, {r('probability')} AS probability FROM nb")
ORACLES["score_with_id"] = sql("large_split nb", f"SELECT o_orderkey AS patient_id, prediction AS readmission_risk, {r('probability')} AS risk_probability FROM nb")
ORACLES["coefficient_round_trip"] = sql("test_scores", f"SELECT o_orderkey, prediction, {r('probability')} AS probability FROM test_scores")
ORACLES["score_by_stage"] = sql("large nb_first nb_second", f"""
SELECT o_orderkey, prediction, {r('probability')} AS probability, 'staging' AS model_stage, '1' AS model_version FROM nb_first
UNION ALL SELECT o_orderkey, prediction, {r('probability')}, 'challenger', '2' FROM nb_second""")
ORACLES["pca_checks"] = "SELECT unnest(['eigenvectors', 'orthonormal', 'largest first', 'largest loading is positive', 'no larger direction is left', 'variance of scores']) AS \"check\", true AS ok"
ORACLES["forest_checks"] = sql("large_split", "SELECT count(*) AS n, true AS shares, true AS classes, true AS repeatable, true AS orders_rows FROM large_split WHERE split = 'test'")
ORACLES["score_stages"] = sql("large nb_first nb_second", f"""
SELECT o_orderkey, prediction, {r('probability')} AS probability, 'staging' AS model_stage, '1' AS model_version FROM nb_first
UNION ALL SELECT o_orderkey, prediction, {r('probability')}, 'production', '2' FROM nb_second
UNION ALL SELECT o_orderkey, prediction, {r('probability')}, 'fallback', '1' FROM nb_first""")
ORACLES["model_round_trip"] = sql("large_split", "SELECT count(*) AS n, 0e0 AS max_probability_diff FROM large_split WHERE split = 'test'")
part("labelled_requests", ("requests",), "SELECT *, CASE WHEN mean_radius + worst_radius + worst_texture < 55 THEN 1 ELSE 0 END AS label FROM requests")
gaussian("nb_requests", "SELECT * FROM labelled_requests", REQUEST_FIELDS, "event_id", "SELECT * FROM labelled_requests",
         ", " + ", ".join(REQUEST_FIELDS))
ORACLES["stream_score"] = sql("labelled_requests nb_requests", f"""
SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS patient_id, prediction, {r('probability', 4)} AS probability,
  {TIER.format(p='probability')} AS risk_level, '7' AS model_version, {RISKS} AS top_risk_factors, {PROTECTIVE} AS protective_factors
FROM nb_requests""")

# --- Evaluation and gates ---------------------------------------------------------------------------------------------

FOUR = ["accuracy", "precision", "recall", "f1_score"]
ORACLES["binary_metrics"] = sql("test_counts", f"SELECT n, {rounded(FOUR)} FROM test_counts")
part("line_counts", ("test_scores",), confusion("test_scores", "n_lines"))
ORACLES["binary_metrics_by_segment"] = sql("line_counts", f"SELECT {r('n_lines')} AS n_lines, n, {rounded(FOUR)} FROM line_counts")
ORACLES["roc_auc_exact"] = sql("test_auc", f"SELECT {r('roc_auc', 9)} AS roc_auc FROM test_auc")
ORACLES["roc_auc_by_segment"] = sql("segment_auc", f"SELECT model, strftime(quarter, '%Y-%m-%d') AS quarter, {r('roc_auc')} AS roc_auc FROM segment_auc")

part("model_counts", ("scored",), confusion("scored", "model"))
part("model_auc", ("scored",), auc("scored", "model"))
ORACLES["five_metrics_by_segment"] = sql("model_counts model_auc", f"""
SELECT model, n, {rounded(FOUR)}, {r('roc_auc')} AS roc_auc FROM model_counts JOIN model_auc USING (model)""")


def gate(name: str, minimum: float, missing: str) -> str:
    """Verdict text of one gate over all versions, by what a missing metric means."""
    def below(m: str, value: str, head: str, tail: str) -> str:
        return f"CASE WHEN {value} < {minimum}e0 THEN '{head}' || printf('%.3f', {r(value, 3)}) || '{tail}' END"
    three = ("accuracy", "precision", "recall")
    if missing == "zero":
        texts = [below(m, f"coalesce({m}, 0)", f"{m.capitalize()} ", f" < {minimum:.3f}") for m in three]
    elif missing == "error":
        texts = [below(m, m, f"{m}: ", f" < {minimum:.3f} (required)") for m in three] if minimum else []
    elif missing == "fail":
        texts = [f"CASE WHEN {m} IS NULL THEN '{m}: missing (required >= {minimum})' ELSE {below(m, m, f'{m}: ', f' < {minimum:.3f}')} END" for m in three]
    else:
        texts = [below(m, m, f"{m}: ", f" < {minimum}") for m in three]
    failures = f"concat_ws('; ', {', '.join(texts)})" if texts else "''"
    absent = "concat_ws('; ', " + ", ".join(f"CASE WHEN {m} IS NULL THEN 'missing {m}' END" for m in three) + ")"
    lost = "accuracy IS NULL OR precision IS NULL OR recall IS NULL"
    if missing != "error":
        lost = "false"
    return f"""
SELECT model, number, '{name}' AS gate, CASE WHEN {lost} THEN 'ERROR' WHEN {failures} <> '' THEN 'FAIL' ELSE 'PASS' END AS outcome,
  CASE WHEN {lost} THEN {absent} ELSE {failures} END AS failures FROM metrics_wide"""


ORACLES["step_gate"] = sql("metrics_wide", gate("step", 0.7, "zero"))
ORACLES["promotion_gate"] = sql("metrics_wide", gate("staging", 0.7, "error") + " UNION ALL " + gate("production", 0.8, "error")
                                + " UNION ALL " + gate("archived", 0, "error"))
ORACLES["cross_gate"] = sql("metrics_wide", gate("enterprise-production", 0.8, "fail"))
ORACLES["lenient_gate"] = sql("metrics_wide", gate("lenient-production", 0.8, "skip"))
GATED = "metric IN ('accuracy', 'precision', 'recall')"
RESULT = f"CASE WHEN NOT {GATED} THEN 'INFO' WHEN value >= 0.7 THEN 'PASS' ELSE 'FAIL' END"
part("metric_slots", ("metrics_wide", "metrics"), """
  SELECT w.model, w.number, metric, coalesce(m.value, 0) AS value FROM metrics_wide w
  CROSS JOIN (SELECT unnest(['accuracy', 'precision', 'recall', 'f1_score', 'roc_auc']) AS metric) LEFT JOIN metrics m USING (model, number, metric)""")
ORACLES["performance_rows"] = sql("metric_slots", f"SELECT model, number, metric, CASE WHEN {GATED} THEN 0.7e0 END AS threshold, {r('value')} AS actual, {RESULT} AS result FROM metric_slots")
part("decided", ("metric_slots",), f"""
  SELECT model, number, count(*) AS checks, count(*) FILTER (WHERE {RESULT} = 'FAIL') AS failed_checks FROM metric_slots GROUP BY 1, 2""")
ORACLES["overall_decision"] = sql("decided", "SELECT *, CASE WHEN failed_checks = 0 THEN 'PASSED' ELSE 'FAILED' END AS decision FROM decided")
ORACLES["after_run_decision"] = sql("decided versions runs", """
SELECT model, number, failed_checks, status AS run_status, CASE WHEN failed_checks = 0 AND status = 'completed' THEN 'PASSED' ELSE 'FAILED' END AS decision
FROM decided JOIN versions USING (model, number) LEFT JOIN runs ON run_id = training_run_id""")
ORACLES["metric_status"] = sql("metrics_wide", "\nUNION ALL ".join(f"""
SELECT model, number, coalesce(accuracy >= 0.8 AND precision >= 0.8 AND recall >= 0.8, false) AS version_passes, '{m}' AS metric, 0.8e0 AS minimum,
  {r(m)} AS value, CASE WHEN {m} IS NULL THEN 'MISSING' WHEN {m} >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS status FROM metrics_wide"""
    for m in ("accuracy", "precision", "recall")))

# --- Champion and challenger ------------------------------------------------------------------------------------------

part("aligned", ("large", "nb_first", "nb_second"), """
  SELECT a.o_orderkey, a.n_lines, a.prediction AS champion_prediction, a.probability AS champion_probability,
         b.prediction AS challenger_prediction, b.probability AS challenger_probability, abs(a.probability - b.probability) AS probability_diff
  FROM nb_first a JOIN nb_second b USING (o_orderkey)""")
ALIGNED = f"o_orderkey, champion_prediction, {r('champion_probability')} AS champion_probability, challenger_prediction, {r('challenger_probability')} AS challenger_probability, {r('probability_diff')} AS probability_diff"
ORACLES["aligned_predictions"] = sql("aligned", f"SELECT {ALIGNED} FROM aligned")
ORACLES["alignment_counts"] = sql("large", f"""
SELECT count(*) FILTER (WHERE hash >= '20' AND hash < 'f0') AS matched, count(*) FILTER (WHERE hash < '20') AS champion_only,
  0::BIGINT AS challenger_only, count(*) FILTER (WHERE hash >= 'f0') AS repeated FROM (SELECT {h(KEY, 'gap')} AS hash FROM large)""")
part("compared", ("aligned",), """
  SELECT count(*) AS total_samples, avg(CASE WHEN champion_prediction = challenger_prediction THEN 1e0 ELSE 0 END) AS agreement_rate,
    avg(champion_prediction) AS champion_positive_rate, avg(challenger_prediction) AS challenger_positive_rate,
    avg(probability_diff) AS avg_probability_diff, max(probability_diff) AS max_probability_diff FROM aligned""")
RATES = ["agreement_rate", "champion_positive_rate", "challenger_positive_rate", "avg_probability_diff", "max_probability_diff"]
ADVICE = """CASE WHEN agreement_rate >= 0.95 AND avg_probability_diff < 0.05 THEN 'SAFE TO PROMOTE'
  WHEN agreement_rate >= 0.85 THEN 'REVIEW RECOMMENDED' ELSE 'CAUTION' END"""
ORACLES["comparison_metrics"] = sql("compared", f"SELECT '1' AS champion_version, '2' AS challenger_version, total_samples, {rounded(RATES)} FROM compared")
ORACLES["comparison_one_pass"] = sql("compared", f"SELECT '1' AS champion_version, '2' AS challenger_version, total_samples, {rounded(RATES)}, {ADVICE} AS recommendation FROM compared")
ORACLES["recommendation"] = sql("compared", f"SELECT '1' AS champion_version, '2' AS challenger_version, {ADVICE} AS recommendation FROM compared")
part("compared_by_lines", ("aligned",), PARTS["compared"][1].replace("SELECT count(*)", "SELECT n_lines, count(*)") + " GROUP BY n_lines")
ORACLES["comparison_by_segment"] = sql("compared_by_lines", f"SELECT {r('n_lines')} AS n_lines, total_samples, {rounded(RATES)}, {ADVICE} AS recommendation FROM compared_by_lines")
ORACLES["disagreements"] = sql("aligned", f"SELECT {ALIGNED} FROM aligned WHERE champion_prediction <> challenger_prediction")

ORACLES["top_disagreements"] = sql("aligned", f"""
SELECT {ALIGNED} FROM (SELECT * FROM aligned WHERE champion_prediction <> challenger_prediction ORDER BY probability_diff DESC, o_orderkey LIMIT 20)""")

# --- Registry ---------------------------------------------------------------------------------------------------------

part("measured", ("metrics_wide", "versions"), """
  SELECT model, coalesce(max(number) FILTER (WHERE environment = 'staging'), max(number)) AS number,
         max(number) FILTER (WHERE environment = 'staging') IS NULL AS fallback
  FROM metrics_wide JOIN versions USING (model, number)
  WHERE accuracy IS NOT NULL AND precision IS NOT NULL AND recall IS NOT NULL GROUP BY model""")
ORACLES["latest_with_metrics"] = sql("measured", "SELECT * FROM measured")
ORACLES["latest_staging_trained"] = sql("versions", "SELECT model, max(number) FILTER (WHERE environment = 'staging') AS number FROM versions GROUP BY model")
ORACLES["comparison_pair"] = sql("versions", """
SELECT model, coalesce(max(number) FILTER (WHERE stage = 'staging'), max(number)) AS champion,
  coalesce(max(number) FILTER (WHERE environment = 'staging'), max(number)) AS challenger FROM versions GROUP BY model""")
_ask = h("model", "ask")
ORACLES["version_lookup"] = sql("measured versions", f"""
SELECT *, number IS NOT NULL AS found FROM (SELECT w.model, w.version, w.from_stage,
  CASE WHEN version IS NOT NULL THEN 'version' WHEN from_stage IS NOT NULL THEN 'stage' ELSE 'metrics' END AS chosen_by,
  CASE WHEN version IS NOT NULL THEN (SELECT max(number) FROM versions v WHERE v.model = w.model AND v.number = w.version)
       WHEN from_stage = 'latest' THEN (SELECT max(number) FROM versions v WHERE v.model = w.model)
       WHEN from_stage IS NOT NULL THEN (SELECT max(number) FROM versions v WHERE v.model = w.model AND v.stage = w.from_stage)
       ELSE (SELECT max(number) FROM measured v WHERE v.model = w.model) END AS number
FROM (SELECT DISTINCT model, CAST(CASE WHEN {_ask} < '60' THEN 1 + length(model) % 30 END AS INTEGER) AS version,
        CASE WHEN {_ask} < '30' THEN 'staging' WHEN {_ask} BETWEEN '60' AND '80' THEN 'latest' WHEN {_ask} BETWEEN '80' AND 'b0' THEN 'production'
             WHEN {_ask} BETWEEN 'b0' AND 'd0' THEN 'staging' END AS from_stage FROM versions) w)""")
part("asked", ("versions",), """
  SELECT model, number FROM versions WHERE number % 3 = 0""")
part("holders", ("versions",), "SELECT model, max(number) AS holder FROM versions WHERE stage = 'production' GROUP BY model")
part("verdicts", ("asked", "metrics_wide", "holders"), """
  SELECT a.model, a.number, h.holder,
    CASE WHEN accuracy IS NULL OR precision IS NULL OR recall IS NULL THEN 'ERROR'
         WHEN accuracy < 0.8 OR precision < 0.8 OR recall < 0.8 THEN 'FAIL' ELSE 'PASS' END AS gate
  FROM asked a LEFT JOIN metrics_wide USING (model, number) LEFT JOIN holders h USING (model)""")
part("forced", ("verdicts", "versions"), """
  SELECT * FROM (SELECT * FROM verdicts QUALIFY number = max(number) OVER (PARTITION BY model)) WHERE gate = 'PASS'""")
ORACLES["promotion_flow"] = sql("verdicts forced versions promotions", """
SELECT model, number, 'decision' AS "row", CASE WHEN gate <> 'PASS' THEN 'refused' WHEN holder <> number THEN 'blocked' ELSE 'promoted' END AS what, gate
FROM verdicts UNION ALL SELECT DISTINCT model, 1000, 'decision', 'not found', 'none' FROM versions
UNION ALL SELECT v.model, v.number, 'entry', coalesce(v.stage, 'none') || ' > ' || CASE WHEN v.number = f.number THEN 'production' ELSE 'archived' END,
  CAST((SELECT count(*) FROM promotions p WHERE p.model = v.model AND p.number = v.number) AS VARCHAR)
FROM forced f JOIN versions v ON v.model = f.model AND (v.number = f.number OR v.number = f.holder)""")
ORACLES["stage_occupancy"] = sql("versions", """
SELECT model, number, 'staging' AS target, CASE WHEN holder <> number THEN holder END AS occupant,
  CASE WHEN holder <> number THEN 'blocked' ELSE 'free' END AS outcome
FROM (SELECT *, max(CASE WHEN stage = 'staging' THEN number END) OVER (PARTITION BY model) AS holder FROM versions)""")
part("promoted", ("promotions", "measured", "versions"), """
  SELECT model, number, seq, from_stage, to_stage FROM promotions
  UNION ALL
  SELECT v.model, v.number, (SELECT count(*) FROM promotions p WHERE p.model = v.model AND p.number = v.number), coalesce(stage, 'none'),
         CASE WHEN v.number = m.number THEN 'staging' ELSE 'archived' END
  FROM versions v JOIN measured m ON v.model = m.model AND (v.number = m.number OR v.stage = 'staging')""")
ORACLES["current_stage"] = sql("promoted", """
SELECT model, number, arg_max(to_stage, seq) AS stage, CAST(max(seq) AS INTEGER) AS seq FROM promoted GROUP BY 1, 2""")
ORACLES["chain_append"] = sql("promoted", """
SELECT model, number, count(*) AS entries, string_agg(CAST(seq AS VARCHAR) || ':' || from_stage || '>' || to_stage, '; ' ORDER BY seq) AS chain
FROM promoted GROUP BY 1, 2""")
ORACLES["stage_history"] = sql("promotions", f"""
SELECT model, number, seq, 'promoted' AS action, lag(to_stage) OVER w AS previous_stage, to_stage AS stage, {stamp('ts')} AS ts,
  {stamp('lead(p.ts) OVER w')} AS until, date_diff('day', p.ts, lead(p.ts) OVER w) AS days_in_stage, lead(p.ts) OVER w IS NULL AS is_last
FROM promotions p WINDOW w AS (PARTITION BY model, number ORDER BY seq)""")
ORACLES["last_actions"] = sql("promotions", """
SELECT model, number, CASE WHEN bool_or(to_stage = 'production') THEN 'imported' ELSE 'promoted' END AS last_action,
  bool_or(to_stage = 'production') AS imported FROM promotions GROUP BY 1, 2""")
part("targets", ("versions",), """
  SELECT model, p.number AS current,
    CASE WHEN EXISTS (SELECT 1 FROM versions v WHERE v.model = a.model AND v.number = p.number - 1) THEN p.number - 1
         ELSE (SELECT max(number) FROM versions v WHERE v.model = a.model AND v.number < p.number AND v.stage = 'archived') END AS target,
    (SELECT max(number) FROM versions v WHERE v.model = a.model AND v.number < p.number) AS previous
  FROM (SELECT DISTINCT model FROM versions) a LEFT JOIN (SELECT model, number FROM versions WHERE stage = 'production') p USING (model)""")
ORACLES["rollback_target"] = sql("targets", "SELECT model, current, target FROM targets")
ORACLES["previous_version"] = sql("targets", "SELECT model, current, previous FROM targets")
ORACLES["rollback_plan"] = sql("targets", """
SELECT model, CASE WHEN current IS NULL THEN 'no production version' WHEN target IS NULL THEN 'no target version' ELSE 'planned' END AS outcome,
  current AS from_version, target AS to_version, 'drift' AS reason, 'rollback' AS triggered_by FROM targets""")
ORACLES["rollback_events"] = sql("targets promotions", """
SELECT v.model, v.number, (SELECT count(*) FROM promotions p WHERE p.model = v.model AND p.number = v.number) AS seq, 'enterprise-production' AS workspace,
  coalesce(stage, 'none') AS from_stage, CASE WHEN v.number = target THEN 'production' ELSE 'archived' END AS to_stage, '2024-06-02 00:00:00' AS ts
FROM versions v JOIN targets t ON v.model = t.model AND v.number IN (t.target, t.current) WHERE t.target IS NOT NULL""")
_fault = h(VERSION, "fault")
_between = lambda low, high: f"{_fault} >= '{low}' AND {_fault} < '{high}'"
_problem = f"""CASE WHEN {_between('10', '20')} THEN 'missing required fields: model_name'
  WHEN {_between('20', '30')} THEN 'missing required fields: export_path' WHEN {_between('30', '40')} THEN 'missing required fields: source'
  WHEN {_between('40', '50')} THEN 'missing required fields: artifacts' WHEN {_between('50', '60')} THEN 'missing required fields: promotion_chain'
  WHEN {_between('60', '70')} THEN 'missing source fields: workspace' WHEN {_between('70', '80')} THEN 'missing source fields: model_version'
  WHEN {_between('80', '90')} THEN 'missing artifacts.model field' END"""
ORACLES["manifest_validation"] = sql("versions", f"SELECT model, number, {_problem} IS NULL AS valid, {_problem} AS problem FROM versions")
ORACLES["import_record"] = sql("versions promotions", f"""
SELECT model, number, 'imported' AS status, 'enterprise-dev-staging' AS source_workspace, 'production' AS dest_stage, has_scaler,
  (SELECT count(*) FROM promotions p WHERE p.model = v.model AND p.number = v.number) + 2 AS entries, 'imported' AS last_action,
  'enterprise-production' AS to_workspace,
  CASE WHEN number % 3 <> 0 THEN {run_link("('import-' || model || '-' || CAST(number AS VARCHAR))", 'enterprise-production')} END AS import_run_url,
  {run_link('training_run_id')} AS training_run_url, '2024-06-01T12:00:00' AS imported_at,
  sha1(model || '/' || CAST(number AS VARCHAR)) AS git_commit FROM versions v""")
_new = "md5('imported/' || version_id)"
ORACLES["back_links"] = sql("versions", f"""
SELECT model, number, 'enterprise-production' AS workspace, 'production' AS stage, {_new} AS model_version_id,
  {version_link(_new, 'enterprise-production')} AS model_version_url, '2024-06-01T13:00:00' AS timestamp FROM versions WHERE versions.stage = 'staging'""")

# --- Lineage, runs ----------------------------------------------------------------------------------------------------

ORACLES["lineage_trace"] = sql("versions runs outputs scored", """
SELECT v.model, v.number, v.stage, v.training_run_id, r.flow, r.status AS run_status, r."user" AS run_user, r."commit", o.output, o.uri, c.n AS n_predictions
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY CASE stage WHEN 'production' THEN 0 ELSE 1 END, number DESC) AS place
      FROM versions WHERE stage IN ('production', 'staging')) v
LEFT JOIN runs r ON r.run_id = v.training_run_id
LEFT JOIN (SELECT * FROM outputs WHERE step = 'load_data') o ON o.run_id = v.training_run_id
LEFT JOIN (SELECT model, quarter, count(*) AS n FROM scored GROUP BY 1, 2) c ON c.model = v.model AND c.quarter = v.quarter
WHERE v.place = 1""")
_acc = f"CAST('0x' || substr({h('step_run_id', 'acc')}, 1, 2) AS INTEGER) / 256e0"
_rec = f"CAST('0x' || substr({h('step_run_id', 'rec')}, 1, 2) AS INTEGER) / 256e0"
ORACLES["run_metrics"] = sql("runs outputs versions metrics", f"""
, direct AS (SELECT run_id, max(step_run_id) AS step_run_id FROM outputs WHERE lower(step) LIKE '%evaluate%' AND lower(output) LIKE '%metrics%' GROUP BY run_id),
trained AS (SELECT training_run_id AS run_id, max((model, number)) AS v FROM versions WHERE training_run_id IS NOT NULL GROUP BY 1)
SELECT run_id, 'accuracy' AS metric, {r(_acc)} AS value, 'output' AS origin FROM direct
UNION ALL SELECT run_id, 'recall', {r(_rec)}, 'output' FROM direct
UNION ALL SELECT t.run_id, m.metric, {r('m.value')}, 'version' FROM trained t JOIN runs USING (run_id)
  JOIN versions x ON x.training_run_id = t.run_id AND (x.model, x.number) = t.v JOIN metrics m ON m.model = x.model AND m.number = x.number
  WHERE t.run_id NOT IN (SELECT run_id FROM direct)""".replace("\n, direct", ", direct", 1))
_seconds = "coalesce((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 0)"
ORACLES["step_durations"] = sql("steps", f"""
SELECT step, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failures, {r(f'avg({_seconds})')} AS mean_seconds,
  {r(f'min({_seconds})')} AS min_seconds, {r(f'max({_seconds})')} AS max_seconds FROM steps GROUP BY step""")
_nl = "chr(10)"
_bullet = lambda name, value: f"|| {_nl} || '• {name}: `' || {value} || '`'"
ORACLES["run_alert_rows"] = sql("steps runs versions", f"""
SELECT 'step/' || CAST(step_run_id AS VARCHAR) AS subject, status,
  CASE WHEN status = 'failed' THEN '❌ *Step Failed*' {_bullet('Pipeline', 'flow')} {_bullet('Step', 'step')} {_bullet('Run', 'run_id')} {_bullet('Error', 'error')}
  ELSE '✅ *Step Succeeded*' {_bullet('Pipeline', 'flow')} {_bullet('Step', 'step')} {_bullet('Run', 'run_id')} END AS message FROM steps
UNION ALL SELECT 'run/' || r.run_id, r.status,
  CASE WHEN r.status = 'failed' THEN '🚨 *Pipeline Failed*' {_bullet('Pipeline', 'flow')} {_bullet('Run', 'r.run_id')} {_bullet('Error', 'e.error')}
    || {_nl} || '• Action Required: Please investigate immediately'
  ELSE '🎉 *Pipeline Completed Successfully*' {_bullet('Pipeline', 'flow')} {_bullet('Run', 'r.run_id')}
    || coalesce({_nl} || '• Model: `' || v.model || '` v' || CAST(v.number AS VARCHAR), '') END
FROM runs r LEFT JOIN (SELECT run_id, arg_min(error, (start_time, step_run_id)) AS error FROM steps WHERE status = 'failed' GROUP BY 1) e ON e.run_id = r.run_id
LEFT JOIN (SELECT model, number, training_run_id, row_number() OVER (PARTITION BY training_run_id ORDER BY model DESC, number DESC) AS place
           FROM versions WHERE training_run_id IS NOT NULL) v ON v.training_run_id = r.run_id AND v.place = 1""")
ORACLES["last_failed_run"] = sql("runs steps", f"""
SELECT r.run_id, r.flow, {stamp('r.start_time')} AS run_start, step, error, step_run_id
FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY start_time DESC, run_id DESC) AS place FROM runs WHERE status = 'failed') r
JOIN steps s ON s.run_id = r.run_id AND s.status = 'failed' WHERE place = 1""")

# --- Described in the guides only -------------------------------------------------------------------------------------


def numeric_drift(column: str, factor: float) -> str:
    """Decile edges of the reference by nearest rank, the stability index over them, and the KS distance."""
    values = (f"SELECT CASE WHEN extract(day FROM ts) > 15 THEN {column} * {factor}e0 ELSE {column} END AS x, "
              f"extract(day FROM ts) > 15 AS cur FROM (SELECT *, CAST(extract(hour FROM ts) AS DOUBLE) AS hour FROM events)")
    edges = ", ".join(f"(SELECT quantile_disc(x, {q / 10}) FROM ({values}) WHERE NOT cur)" for q in range(1, 10))
    share = lambda flag: f"greatest(count(*) FILTER (WHERE {flag}) / (SELECT count(*) FROM ({values}) WHERE {flag}), 0.0001e0)"
    psi = (f"(SELECT sum((b - a) * ln(b / a)) FROM (SELECT {share('NOT cur')} AS a, {share('cur')} AS b "
           f"FROM (SELECT cur, len(list_filter([{edges}], lambda e: e < x)) AS bin FROM ({values})) GROUP BY bin))")
    part_of = lambda flag: f"sum({flag}) OVER (ORDER BY x) / sum({flag}) OVER ()"
    ks = (f"(SELECT max(abs({'ra'} - {'rb'})) FROM (SELECT {part_of('a')} AS ra, {part_of('b')} AS rb FROM (SELECT x, "
          f"CAST(count(*) FILTER (WHERE NOT cur) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE cur) AS DOUBLE) AS b FROM ({values}) GROUP BY x)))")
    return f"SELECT '{column}' AS \"column\", {psi} AS psi, {ks} AS ks"


CATEGORY = """SELECT 'event_type' AS "column", (SELECT sum((b - a) * ln(b / a)) FROM (
  SELECT greatest(count(*) FILTER (WHERE day <= 15) / (SELECT count(*) FROM events WHERE extract(day FROM ts) <= 15), 0.0001e0) AS a,
         greatest(count(*) FILTER (WHERE day > 15) / (SELECT count(*) FROM events WHERE extract(day FROM ts) > 15), 0.0001e0) AS b
  FROM (SELECT event_type, extract(day FROM ts) AS day FROM events) GROUP BY event_type)) AS psi, CAST(NULL AS DOUBLE) AS ks"""
for _pair, _factor in (("plain", 1.0), ("shifted", 1.5)):
    part(f"drift_{_pair}", (), f"{numeric_drift('value', _factor)} UNION ALL {numeric_drift('hour', 1.0)} UNION ALL {CATEGORY}")
part("drift", ("drift_plain", "drift_shifted"), """
  SELECT *, 'plain' AS pair, psi > 0.2 AS drifted FROM drift_plain UNION ALL SELECT *, 'shifted', psi > 0.2 FROM drift_shifted""")
ORACLES["drift_columns"] = sql("drift", f"SELECT \"column\", {r('psi')} AS psi, {r('ks')} AS ks, drifted, pair FROM drift")
_score = f"""count(*) AS n_columns, count(*) FILTER (WHERE drifted) AS n_drifted,
  {r('count(*) FILTER (WHERE drifted) / count(*)')} AS drift_score, count(*) FILTER (WHERE drifted) / count(*) > 0.3 AS alert"""
ORACLES["drift_score"] = sql("drift", f"SELECT pair, {_score} FROM drift GROUP BY pair")
ORACLES["retrain_trigger"] = sql("drift", f"SELECT {_score}, alert AS retrain FROM drift WHERE pair = 'shifted' AND \"column\" = 'value'")
part("audit", ("promotions", "runs"), """
  SELECT 'model_promotion' AS event_type, model || '/' || CAST(number AS VARCHAR) || '/' || CAST(seq AS VARCHAR) AS subject,
         from_stage || ' -> ' || to_stage AS detail, ts FROM promotions
  UNION ALL SELECT 'pipeline_run', run_id, flow || ' ' || status, start_time FROM runs""")
AUDIT = f"SELECT event_type, subject, detail, {stamp('a.ts')} AS ts, 'cancer-detection' AS project, strftime(a.ts, '%Y-%m-%d') AS date FROM audit a"
ORACLES["audit_export"] = sql("audit", f"{AUDIT} WHERE CAST(a.ts AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2024-01-20'")
ORACLES["retention"] = sql("audit", f"{AUDIT} WHERE CAST(a.ts AS DATE) >= DATE '2024-04-10' - 90")
ORACLES["keep_last_runs"] = sql("runs", """
SELECT flow, run_id, row_number() OVER (PARTITION BY flow ORDER BY start_time DESC, run_id DESC) AS rank, status FROM runs QUALIFY rank <= 100""")
ORACLES["approval_gate"] = """
SELECT model, number, count(DISTINCT user_id) AS approvers, count(DISTINCT user_id) FILTER (WHERE user_id % 3 = 1) AS allowed_approvers,
  count(DISTINCT user_id) FILTER (WHERE user_id % 3 = 1) >= 2 AS approved
FROM (SELECT 'model_' || CAST(event_id % 25 AS VARCHAR) AS model, CAST(1 + (event_id // 25) % 27 AS INTEGER) AS number, user_id
      FROM events) GROUP BY 1, 2"""
ORACLES["prediction_log_sample"] = sql("scored", f"""
SELECT o_orderkey, model, prediction, {r('probability')} AS probability FROM scored WHERE substr({h(KEY, 'log')}, 1, 6) < '199999'""")
ORACLES["stream_monitor"] = f"""
SELECT {stamp('start')} AS window_start, {stamp("start + INTERVAL 1 HOUR")} AS window_end, count(*) AS n,
  {r('count(*) FILTER (WHERE value > 50) / count(*)')} AS positive_rate, {r('avg(value / (value + 50))')} AS mean_probability
FROM (SELECT *, date_trunc('hour', ts) AS start FROM events) GROUP BY start"""
