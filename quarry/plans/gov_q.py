"""Governance queries."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import governance as G
from quarry.plans import sqlbase as S
from quarry.plans.registry import finalize, query
from quarry.sources import testmap
from quarry.sources.tables import load

_EDGES = [float(x) for x in np.linspace(0.0, 1.0, config.CALIBRATION_BINS + 1)]

AUDIT_SQL = """
aud AS (
  SELECT event_id AS entry_id, ts AS timestamp, sha256(concat_ws('|', event_id, ts, user_id, event_type, value)) AS checksum
  FROM events),
aud2 AS (SELECT *, lag(checksum) OVER (ORDER BY timestamp, entry_id) AS prev FROM aud),
aud3 AS (SELECT entry_id, timestamp, checksum, CASE WHEN entry_id % 997 = 500 THEN sha256(CAST(entry_id AS VARCHAR)) ELSE prev END
  AS previous_checksum, prev AS expected FROM aud2),
chk AS (SELECT *, expected IS NOT NULL AND coalesce(previous_checksum, '') <> expected AS broken_link FROM aud3)"""


@query("w13_audit_chain", "WITH " + AUDIT_SQL + """
SELECT entry_id, broken_link,
  (SELECT min((timestamp, entry_id)) FROM chk WHERE broken_link) IS NOT NULL
    AND (timestamp, entry_id) >= (SELECT min((timestamp, entry_id)) FROM chk WHERE broken_link) AS reported_invalid
FROM chk""")
def q_w13(spark, sf):
    ev = load(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return finalize(G.verify_chain(G.audit_entries(ev)).select("entry_id", "broken_link", "reported_invalid"))


PRED_SQL = """
pred AS (
  SELECT d.doc_id AS prediction_id, d.source AS agent_name, d.lang AS action_type, (d.n_chars % 1000) / 1000.0 AS confidence,
    CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 AND l.toxic = 0 THEN 'accepted'
         WHEN l.quality = 1 THEN 'modified' ELSE 'rejected' END AS outcome_type
  FROM documents d LEFT JOIN labels l USING (doc_id)),
dec AS (SELECT *, CASE outcome_type WHEN 'accepted' THEN 1.0 WHEN 'auto_executed' THEN 1.0 WHEN 'modified' THEN 0.5
  ELSE 0.0 END AS credit FROM pred WHERE outcome_type IN ('accepted', 'auto_executed', 'modified', 'rejected'))"""
_BIN = "CASE " + " ".join(
    (f"WHEN confidence >= {_EDGES[i]!r} AND confidence <= {_EDGES[i + 1]!r} THEN {i}" if i == len(_EDGES) - 2
     else f"WHEN confidence >= {_EDGES[i]!r} THEN {i}") for i in range(len(_EDGES) - 2, -1, -1)) + " END"
_BINS_V = ", ".join(f"({i}, {_EDGES[i]!r}, {_EDGES[i + 1]!r})" for i in range(len(_EDGES) - 1))
BINS_SQL = f"""
g AS (SELECT {_BIN} AS bin, count(*) AS count, avg(confidence) AS avg_confidence, avg(credit) AS accuracy FROM dec GROUP BY 1),
bins AS (
  SELECT b.bin, b.bin_start, b.bin_end, coalesce(g.count, 0) AS count,
    coalesce(g.avg_confidence, (CAST(b.bin_start AS DOUBLE) + b.bin_end) / 2) AS avg_confidence, coalesce(g.accuracy, 0.0) AS accuracy,
    CASE WHEN g.count IS NULL THEN 0.0 ELSE abs(g.accuracy - g.avg_confidence) END AS calibration_error
  FROM (SELECT * FROM (VALUES {_BINS_V}) t(bin, bin_start, bin_end)) b LEFT JOIN g USING (bin))"""


@query("a40_calibration_bins", "WITH " + PRED_SQL + "," + BINS_SQL + """
SELECT CAST(bin AS BIGINT) AS bin, round(CAST(bin_start AS DOUBLE), 6) AS bin_start, round(CAST(bin_end AS DOUBLE), 6) AS bin_end, count,
  round(avg_confidence, 6) AS avg_confidence, round(accuracy, 6) AS accuracy, round(calibration_error, 6) AS calibration_error
FROM bins""")
def q_a40(spark, sf):
    return finalize(G.calibration_bins(testmap.predictions(spark, sf)))


_STATUS = "CASE " + " ".join(f"WHEN ece < {t} THEN '{lab}'" for t, lab in config.CALIBRATION_STATUS) + \
    f" ELSE '{config.CALIBRATION_STATUS_TOP}' END"


@query("a41_calibration_metrics", "WITH " + PRED_SQL + "," + BINS_SQL + f""",
m AS (SELECT (SELECT count(*) FROM pred) AS total_predictions, count(*) AS predictions_with_outcomes,
  avg((confidence - credit) * (confidence - credit)) AS brier_score, avg(credit) AS overall_accuracy,
  avg(CAST(outcome_type = 'accepted' AS DOUBLE)) AS acceptance_rate, avg(CAST(outcome_type = 'modified' AS DOUBLE)) AS modification_rate,
  avg(CAST(outcome_type = 'rejected' AS DOUBLE)) AS rejection_rate FROM dec),
b AS (SELECT CASE WHEN sum(count) > 0 THEN sum(count * calibration_error) / sum(count) ELSE 0.0 END AS ece,
  max(calibration_error) AS mce FROM bins)
SELECT total_predictions, predictions_with_outcomes, round(ece, 6) AS expected_calibration_error,
  round(mce, 6) AS maximum_calibration_error, round(brier_score, 6) AS brier_score, round(overall_accuracy, 6) AS overall_accuracy,
  round(acceptance_rate, 6) AS acceptance_rate, round(modification_rate, 6) AS modification_rate,
  round(rejection_rate, 6) AS rejection_rate, {_STATUS} AS calibration_status
FROM m, b""")
def q_a41(spark, sf):
    return finalize(G.calibration_metrics(testmap.predictions(spark, sf)))


@query("a42_acceptance_by_agent", "WITH " + PRED_SQL + """
SELECT agent_name, count(*) AS total, count(outcome_type) AS decided, count(*) FILTER (WHERE outcome_type IS NULL) AS pending,
  count(*) FILTER (WHERE outcome_type = 'accepted') AS accepted, count(*) FILTER (WHERE outcome_type = 'modified') AS modified,
  count(*) FILTER (WHERE outcome_type = 'rejected') AS rejected, round(avg(confidence), 6) AS avg_confidence,
  round(CASE WHEN count(outcome_type) > 0 THEN count(*) FILTER (WHERE outcome_type = 'accepted') / count(outcome_type) END, 6)
    AS acceptance_rate
FROM pred GROUP BY agent_name""")
def q_a42(spark, sf):
    return finalize(G.acceptance_by_agent(testmap.predictions(spark, sf)))


def _metrics_sql(name: str, where: str) -> str:
    """Calibration metrics (A41) of the predictions matching `where`."""
    return f"""
{name}_dec AS (SELECT * FROM dec WHERE {where}),
{name}_g AS (SELECT {_BIN} AS bin, count(*) AS count, avg(confidence) AS c, avg(credit) AS a FROM {name}_dec GROUP BY 1),
{name}_b AS (SELECT CASE WHEN sum(count) > 0 THEN sum(count * abs(a - c)) / sum(count) ELSE 0.0 END AS expected_calibration_error
  FROM {name}_g),
{name} AS (SELECT avg(credit) AS overall_accuracy, avg(CAST(outcome_type = 'accepted' AS DOUBLE)) AS acceptance_rate,
  avg(CAST(outcome_type = 'rejected' AS DOUBLE)) AS rejection_rate, (SELECT expected_calibration_error FROM {name}_b)
  AS expected_calibration_error FROM {name}_dec)"""


_T = config.DRIFT_THRESHOLDS
DRIFT_SQL = "WITH " + PRED_SQL + "," + _metrics_sql("cur", "action_type <> 'en'") + "," + _metrics_sql("base", "action_type = 'en'") + f""",
r AS (
  SELECT 0 AS ordinal, 'accuracy_drift' AS drift_type, 'overall_accuracy' AS metric_name,
    CASE WHEN b.overall_accuracy > 0 THEN (b.overall_accuracy - c.overall_accuracy) / b.overall_accuracy END AS change,
    {_T['accuracy_drop']!r} AS threshold, c.overall_accuracy AS current_value, b.overall_accuracy AS baseline_value FROM cur c, base b
  UNION ALL SELECT 1, 'calibration_drift', 'expected_calibration_error', c.expected_calibration_error - b.expected_calibration_error,
    {_T['ece_increase']!r}, c.expected_calibration_error, b.expected_calibration_error FROM cur c, base b
  UNION ALL SELECT 2, 'acceptance_drift', 'acceptance_rate',
    CASE WHEN b.acceptance_rate > 0 THEN (b.acceptance_rate - c.acceptance_rate) / b.acceptance_rate END,
    {_T['acceptance_drop']!r}, c.acceptance_rate, b.acceptance_rate FROM cur c, base b
  UNION ALL SELECT 3, 'acceptance_drift', 'rejection_rate',
    CASE WHEN c.rejection_rate > 0 AND b.rejection_rate > 0 THEN (c.rejection_rate - b.rejection_rate) / b.rejection_rate END,
    {_T['rejection_spike']!r}, c.rejection_rate, b.rejection_rate FROM cur c, base b),
alerts AS (SELECT *, CASE {' '.join(f"WHEN change / threshold >= {t} THEN '{lab}'" for t, lab in config.DRIFT_SEVERITY)} ELSE 'low' END
  AS severity FROM r WHERE change > threshold)"""


def _split_metrics(spark, sf):
    p = testmap.predictions(spark, sf)
    # baseline: English-language predictions; current: the other languages
    cur = G.calibration_metrics(p.filter(F.col("action_type") != "en"))
    base = G.calibration_metrics(p.filter(F.col("action_type") == "en"))
    return cur, base


@query("a43_drift_alerts", DRIFT_SQL + """
SELECT CAST(ordinal AS BIGINT) AS ordinal, drift_type, metric_name, round(change, 6) AS change, round(threshold, 6) AS threshold,
  round(current_value, 6) AS current_value, round(baseline_value, 6) AS baseline_value, severity FROM alerts""")
def q_a43(spark, sf):
    cur, base = _split_metrics(spark, sf)
    return finalize(G.drift_alerts(cur, base))


_R = config.RECAL_THRESHOLDS
_DAYS_SINCE = 45


@query("a44_recalibration_triggers", DRIFT_SQL + f"""
SELECT 'threshold' AS trigger_type, 'ece' AS metric FROM cur WHERE expected_calibration_error > {_R['ece_threshold']}
UNION ALL SELECT 'performance', 'accuracy' FROM cur WHERE overall_accuracy < {_R['accuracy_threshold']}
UNION ALL SELECT 'performance', 'rejection_rate' FROM cur WHERE rejection_rate > {_R['rejection_threshold']}
UNION ALL SELECT 'time_based', 'days_since_calibration' WHERE {_DAYS_SINCE} > {_R['days_since_calibration']}
UNION ALL SELECT 'drift', 'drift_alerts' WHERE (SELECT count(*) FROM alerts) > 0""")
def q_a44(spark, sf):
    cur, base = _split_metrics(spark, sf)
    return finalize(G.recalibration_triggers(cur, G.drift_alerts(cur, base), _DAYS_SINCE))
