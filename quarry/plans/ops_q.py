"""Operational statistics, digest findings, folds, correlations, Platt."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import ml as ML
from quarry.operators import opsstats as OS
from quarry.plans import sqlbase as S
from quarry.plans.core import rec
from quarry.plans.ml_q import FEATURES
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH, enhanced_record
from quarry.sources import testmap
from quarry.sources.tables import load

_ERR = """
err AS (SELECT event_id, ts, CASE WHEN k < 10 THEN 'critical' WHEN k < 30 THEN 'high' WHEN k < 70 THEN 'medium' ELSE 'low' END AS severity,
  'component_' || CAST(user_id % 10 AS VARCHAR) AS component, value >= 100 AS resolved
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type = 'error')"""


@query("a45_error_summary", "WITH " + _ERR + """
SELECT dimension, value, count(*) AS errors, count(*) FILTER (WHERE NOT resolved) AS unresolved FROM (
  SELECT 'severity' AS dimension, severity AS value, resolved FROM err UNION ALL SELECT 'component', component, resolved FROM err)
GROUP BY ALL""")
def q_a45(spark, sf):
    ev = load(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return finalize(OS.error_summary(OS.error_log(ev)))


@query("a47_slow_queries", f"""
SELECT 'q' || json_extract_string(props, '$.k') AS query_hash, count(*) AS runs, round(avg(value * 10), 6) AS mean_ms,
  round(max(value * 10), 6) AS max_ms FROM events GROUP BY 1 HAVING count(*) > {config.SLOW_QUERY_MIN_COUNT}
ORDER BY avg(value * 10) DESC, query_hash LIMIT 10""")
def q_a47(spark, sf):
    return finalize(OS.slow_queries(load(spark, sf, "events", ["value", "props"])))


@query("a48_cache_stats", """
SELECT round(min(value), 6) AS min_ms, round(avg(value), 6) AS mean_ms, round(max(value), 6) AS max_ms,
  round(avg(CAST(event_type IN ('view', 'click') AS DOUBLE)), 6) AS hit_rate, count(*) AS requests FROM events""")
def q_a48(spark, sf):
    return finalize(OS.cache_stats(load(spark, sf, "events", ["event_type", "value"])))


_D43 = " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{sev}' AS severity, '{title}' AS title, '{metric}' AS metric, round({metric}, 6) AS value "
    f"FROM m WHERE {metric} {op} {thr}" for i, (metric, op, thr, sev, title) in enumerate(config.DIGEST_RULES))


@query("d43_digest_findings", ENH + f"""
, m AS (SELECT avg(dqi_score) AS mean_dqi, avg(CAST(tier2_clean AS DOUBLE)) * 100 AS tier2_clean_rate,
  avg(CAST(dblock_tier1_ready AS DOUBLE)) * 100 AS dblock_ready_rate, avg(CAST(total_issues_all_sources > 0 AS DOUBLE)) * 100 AS issue_rate
  FROM elock)
SELECT CAST(ordinal AS BIGINT) AS ordinal, severity, title, metric, value FROM ({_D43})""")
def q_d43(spark, sf):
    return finalize(OS.digest_findings(enhanced_record(spark, sf)))


@query("m17_stratified_kfold", S.with_record() + """
SELECT patient_key, risk_level, CAST((row_number() OVER (PARTITION BY risk_level ORDER BY md5(patient_key)) - 1) % 5 AS BIGINT) AS fold
FROM record""")
def q_m17(spark, sf):
    r = rec(spark, sf).select("patient_key", "risk_level")
    return finalize(ML.kfold(r, "risk_level", F.md5(F.col("patient_key"))))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@query("m2_correlation_pairs", S.with_record() + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(CASE WHEN var_samp(CAST({a} AS DOUBLE)) > 0 AND var_samp(CAST({b} AS DOUBLE)) > 0 "
    f"THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END, 6) AS r FROM record" for a, b in _PAIRS))
def q_m2(spark, sf):
    return finalize(ML.correlation_pairs(rec(spark, sf), FEATURES))


@query("m19_platt_calibration")
def q_m19(spark, sf):
    p = testmap.predictions(spark, sf).filter(F.col("outcome_type").isNotNull())
    out = ML.platt_calibration(p, "confidence", F.col("outcome_type") == "accepted")
    return finalize(out.select("prediction_id", "confidence", "outcome_type", "calibrated"))
