"""The SQL of the queries in ``checks.flows``."""

from __future__ import annotations

from checks.oracle import ORACLES, REQUEST_FIELDS, TIER, VERSION, gaussian, h, part, r, sql
from checks.oracle import _score as SCORE

# A single cut: of all middles between neighbouring values the one with the largest fall in gini impurity.
part("stump", ("large_split",), """
  SELECT cut, n, p, ln, lp FROM (
    SELECT *, 2 * (p / n) * (1 - p / n) - ln / n * 2 * (lp / ln) * (1 - lp / ln) - (n - ln) / n * 2 * ((p - lp) / (n - ln)) * (1 - (p - lp) / (n - ln)) AS gain
    FROM (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS cut, sum(c) OVER (ORDER BY v) AS ln, sum(ones) OVER (ORDER BY v) AS lp,
                 sum(c) OVER () AS n, sum(ones) OVER () AS p
          FROM (SELECT n_lines AS v, CAST(count(*) AS DOUBLE) AS c, CAST(sum(label) AS DOUBLE) AS ones FROM large_split WHERE split = 'train' GROUP BY 1))
    WHERE cut IS NOT NULL) ORDER BY gain DESC, cut LIMIT 1""")
ORACLES["forest_stump_nodes"] = sql("stump", f"""
SELECT 0 AS tree, 0 AS node, 'n_lines' AS feature, {r('cut')} AS cut, 1 AS "left", 2 AS "right", CAST(n AS BIGINT) AS "rows", {r('p / n')} AS share FROM stump
UNION ALL SELECT 0, 1, NULL, NULL, NULL, NULL, CAST(ln AS BIGINT), {r('lp / ln')} FROM stump
UNION ALL SELECT 0, 2, NULL, NULL, NULL, NULL, CAST(n - ln AS BIGINT), {r('(p - lp) / (n - ln)')} FROM stump""")
ORACLES["forest_stump_score"] = sql("large_split stump", f"""
SELECT o_orderkey, CASE WHEN share > 0.5 THEN 1 ELSE 0 END AS prediction, {r('share')} AS probability
FROM (SELECT o_orderkey, CASE WHEN n_lines <= cut THEN lp / ln ELSE (p - lp) / (n - ln) END AS share FROM large_split, stump WHERE split = 'test')""")
ORACLES["forest_nodes_score"] = sql("large_split", """
SELECT count(*) AS n, 0 AS other_class, true AS equal_scores, 50 AS trees FROM large_split WHERE split = 'test'""")

ORACLES["promotion_append"] = sql("promoted", """
SELECT model, number, arg_max(to_stage, seq) AS stage, CAST(max(seq) AS INTEGER) AS seq, CAST(count(*) AS INTEGER) AS entries,
  true AS stored_once, true AS refused FROM promoted GROUP BY 1, 2""")

ORACLES["train_register_score"] = sql("large", """
SELECT o_orderkey, step, 'production' AS model_stage, version AS model_version, true AS scored, 'promoted, refused, promoted, blocked, promoted' AS decisions
FROM large, (VALUES ('first', '1'), ('released', '2'), ('rolled back', '1')) s(step, version)""")

gaussian("nb_odd", "SELECT * FROM labelled_requests WHERE event_id % 2 = 1", REQUEST_FIELDS, "event_id", "SELECT * FROM labelled_requests")
ORACLES["stream_score_stage"] = sql("labelled_requests nb_requests nb_odd", f"""
SELECT event_id, prediction, {r('probability', 4)} AS probability, {TIER.format(p='probability')} AS risk_level, version AS model_version, NULL AS problem
FROM (SELECT event_id, prediction, probability, '1' AS version FROM nb_requests WHERE event_id % 2 = 0
      UNION ALL SELECT event_id, prediction, probability, '2' FROM nb_odd WHERE event_id % 2 = 1) WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL,
  CASE event_id % 9 WHEN 3 THEN 'not a number: mean_radius' ELSE 'body is not a JSON object' END FROM events WHERE event_id % 3 = 0""")

ORACLES["smote_hashed"] = """
SELECT label, most AS n, most - n AS n_synthetic, most AS n_keys, true AS inside FROM (
  SELECT *, max(n) OVER () AS most FROM (
    SELECT CASE WHEN label < 6 THEN 0 WHEN label < 9 THEN 1 ELSE 2 END AS label, count(*) AS n FROM embeddings GROUP BY 1))"""

part("production_changes", ("promotions",), """
  SELECT model, ts AS at, max(number) FILTER (WHERE to_stage = 'production') AS production FROM promotions
  WHERE to_stage = 'production' OR from_stage = 'production' GROUP BY 1, 2""")
ORACLES["scored_by_version"] = sql("scored production_changes", f"""
SELECT s.o_orderkey, s.model, c.production FROM (
  SELECT o_orderkey, CASE WHEN {h('o_orderkey', 'hot')} < '80' THEN 'breast_cancer_0' ELSE model END AS model, o_orderdate AS ts FROM scored) s
ASOF LEFT JOIN production_changes c ON s.model = c.model AND s.ts >= c.at""")
_import = h(VERSION, "import")
ORACLES["lineage_hops"] = "WITH RECURSIVE " + sql("versions", f"""
, links AS (SELECT {VERSION} AS node, CASE WHEN {_import} < '08' THEN {VERSION} WHEN {_import} < '18' THEN model || '/' || CAST(number + 1 AS VARCHAR)
    WHEN {_import} < 'a8' THEN model || '/' || CAST(number - 1 AS VARCHAR) END AS source FROM versions),
walk AS (SELECT node, node AS at, 0 AS hops FROM links
  UNION ALL SELECT w.node, l.source, w.hops + 1 FROM walk w JOIN links l ON l.node = w.at WHERE l.source IS NOT NULL AND w.hops <= (SELECT count(*) FROM links)),
ended AS (SELECT w.node, w.at, w.hops FROM walk w LEFT JOIN links l ON l.node = w.at WHERE l.source IS NULL)
SELECT l.node, e.at AS origin, CAST(e.hops AS BIGINT) AS hops, e.at IS NULL AS looped FROM links l LEFT JOIN ended e ON e.node = l.node""").removeprefix("WITH ")
ORACLES["drift_from_profile"] = sql("drift_shifted", f"""SELECT "column", {r('psi')} AS psi, psi > 0.2 AS drifted FROM drift_shifted""")
ORACLES["retention_apply"] = ORACLES["retention"]
ORACLES["retention_dry_run"] = sql("audit", """
SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, count(*) FILTER (WHERE fresh) AS kept, count(*) FILTER (WHERE NOT fresh) AS removed,
  CASE WHEN bool_and(fresh) THEN 'keep' WHEN NOT bool_or(fresh) THEN 'drop' ELSE 'rewrite' END AS action
FROM (SELECT *, CAST(ts AS DATE) >= DATE '2024-04-10' - 90 AS fresh FROM audit) GROUP BY 1""")
ORACLES["dq_incremental"] = ORACLES["dq_gate"]
ORACLES["comparison_pair_of_run"] = sql("versions", f"""
SELECT model, coalesce(CASE WHEN NOT {h('model', 'empty')} < '80' THEN held END, own, newest) AS champion, coalesce(trained, own, newest) AS challenger FROM (
  SELECT model, max(number) FILTER (WHERE stage = 'staging') AS held, max(number) FILTER (WHERE environment = 'staging') AS trained,
         max(number) AS newest, CASE WHEN {h('model', 'run')} < '80' THEN min(number) END AS own FROM versions GROUP BY model)""")
ORACLES["retrain_trigger_all_columns"] = sql("drift", f"SELECT {SCORE}, alert AS retrain FROM drift WHERE pair = 'shifted'")
_late = "event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-10'"
ORACLES["stream_monitor_late"] = ORACLES["stream_monitor"].replace("FROM events)", f"FROM events WHERE NOT ({_late}))")
