"""Report view queries."""
from __future__ import annotations

import numpy as np  # noqa: F401
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import views as V
from quarry.plans import sqlbase as S
from quarry.plans.bench_q import SITE_BASE, site_base
from quarry.plans.cascade_q import CASCADE_SQL, cascade_record
from quarry.plans.collab_q import ALERTS_SQL, _alerts
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH, enhanced_record


@query("a49_portfolio_rollup", ENH + """
SELECT study_id, site_id, count(*) AS patients, round(avg(dqi_score), 6) AS dqi_mean,
  round(quantile_cont(dqi_score, 0.5), 6) AS dqi_median, round(stddev_samp(dqi_score), 6) AS dqi_std,
  round(min(dqi_score), 6) AS dqi_min, round(max(dqi_score), 6) AS dqi_max,
  count(*) FILTER (WHERE tier1_clean) AS tier1_clean, count(*) FILTER (WHERE tier2_clean) AS tier2_clean,
  count(*) FILTER (WHERE dblock_tier1_ready) AS ready,
  CASE GROUPING(study_id, site_id) WHEN 3 THEN 'portfolio' WHEN 1 THEN 'study' ELSE 'site' END AS level
FROM elock GROUP BY ROLLUP (study_id, site_id)""")
def q_a49(spark, sf):
    return finalize(V.portfolio_rollup(enhanced_record(spark, sf)))


@query("a51_regional_metrics", ENH + """
SELECT region, count(*) AS patients, count(DISTINCT site_id) AS sites, round(coalesce(avg(dqi_score), 0.0), 6) AS dqi_mean
FROM elock GROUP BY region""")
def q_a51(spark, sf):
    return finalize(V.regional_metrics(enhanced_record(spark, sf)))


_BANDS = [(lab, thr, i) for i, (thr, lab) in enumerate(config.DQI_BANDS)] + [(config.DQI_BAND_FLOOR, 0.0, len(config.DQI_BANDS))]
_BANDS_V = ", ".join(f"('{lab}', {thr!r}, {i})" for lab, thr, i in _BANDS)


@query("a52_band_histogram", ENH + f"""
, bands AS (SELECT * FROM (VALUES {_BANDS_V}) t(band, lower, ordinal)),
c AS (SELECT dqi_band AS band, count(*) AS patients FROM elock GROUP BY 1)
SELECT b.band, CAST(b.ordinal AS BIGINT) AS ordinal, round(CAST(b.lower AS DOUBLE), 6) AS lower,
  coalesce(c.patients, 0) AS patients, round(coalesce(c.patients, 0) * 100.0 / (SELECT count(*) FROM elock), 6) AS pct
FROM bands b LEFT JOIN c USING (band)""")
def q_a52(spark, sf):
    return finalize(V.band_histogram(enhanced_record(spark, sf)))


_SB = ["study_id", "site_id", "patient_count", "dqi_mean", "ready_rate"]


@query("o2_top_bottom_sites", ENH + SITE_BASE + """
, t AS (SELECT study_id, site_id, patient_count, round(dqi_mean, 6) AS dqi_mean, round(ready_rate, 6) AS ready_rate, 'top' AS list
        FROM site_base ORDER BY dqi_mean DESC, study_id, site_id LIMIT 10),
b AS (SELECT study_id, site_id, patient_count, round(dqi_mean, 6) AS dqi_mean, round(ready_rate, 6) AS ready_rate, 'bottom' AS list
        FROM site_base ORDER BY dqi_mean ASC, study_id, site_id LIMIT 10)
SELECT * FROM t UNION ALL SELECT * FROM b""")
def q_o2(spark, sf):
    return finalize(V.top_bottom_sites(site_base(spark, sf).select(*_SB), "dqi_mean"))


_TIER = "CASE lower(priority_tier) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.QUEUE_TIER_POINTS.items()) + " ELSE 0 END"
_PRIM = "CASE " + " ".join(f"WHEN issue_{t} = 1 THEN '{t}'" for t in config.QUEUE_PRIMARY_ISSUES) + " ELSE 'other' END"


@query("o7_work_queue", CASCADE_SQL + "," + ISSUES + f"""
SELECT i.patient_key, i.site_id, i.priority_tier, round(coalesce(e.dqi_score, 100.0), 6) AS dqi_score,
  round(coalesce(c.cascade_impact_score, 0.0), 6) AS cascade_impact, CAST(i.total_issues AS BIGINT) AS total_issues,
  round(CAST({_TIER} AS DOUBLE) + (100.0 - coalesce(e.dqi_score, 100.0)) * 0.5 + coalesce(c.cascade_impact_score, 0.0) * 0.3
    + i.total_issues * 2, 6) AS queue_score, {_PRIM} AS primary_issue
FROM iss i LEFT JOIN elock e USING (patient_key) LEFT JOIN cascade c USING (patient_key)
WHERE i.total_issues > 0
ORDER BY CAST({_TIER} AS DOUBLE) + (100.0 - coalesce(e.dqi_score, 100.0)) * 0.5 + coalesce(c.cascade_impact_score, 0.0) * 0.3
  + i.total_issues * 2 DESC, i.patient_key ASC LIMIT 20""")
def q_o7(spark, sf):
    return finalize(V.work_queue(issue_record(spark, sf), enhanced_record(spark, sf), cascade_record(spark, sf)))


_SAE_SQL = ALERTS_SQL + f""",
cases AS (
  SELECT alert_id, recipient_id, created_at, value,
    (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(created_at)) / 3600000000.0 AS hours_elapsed,
    {float(config.SAE_SLA_HOURS)!r} - (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(created_at)) / 3600000000.0 AS hours_remaining
  FROM alerts WHERE category = 'safety')"""


@query("a57_sae_sla_class", "WITH " + _SAE_SQL + """
SELECT alert_id, round(hours_remaining, 6) AS hours_remaining,
  CASE WHEN hours_remaining < 0 THEN 'breached' WHEN hours_remaining < 24 THEN 'critical' WHEN hours_remaining < 48 THEN 'warning'
       ELSE 'safe' END AS sla_status,
  round(CASE WHEN hours_remaining < 0 THEN 1.0 WHEN hours_remaining < 24 THEN 0.75 + (24.0 - hours_remaining) / 24 * 0.20
       WHEN hours_remaining < 48 THEN 0.30 + (48.0 - hours_remaining) / 24 * 0.45
       ELSE greatest(0.05, 0.30 - hours_remaining / 100) END, 6) AS breach_probability
FROM cases""")
def q_a57(spark, sf):
    c = V.sla_class(V.sae_cases(_alerts(spark, sf), config.AS_OF_EVENTS))
    return finalize(c.select("alert_id", "hours_remaining", "sla_status", "breach_probability"))


@query("a56_case_timeline", "WITH " + _SAE_SQL + """
SELECT CAST(created_at AS DATE) AS day, count(*) AS cases, count(*) FILTER (WHERE value > 200) AS serious FROM cases GROUP BY 1""")
def q_a56(spark, sf):
    return finalize(V.case_timeline(V.sae_cases(_alerts(spark, sf), config.AS_OF_EVENTS)))


@query("a70_query_load_top", ENH + """
SELECT study_id, site_id, CAST(sum(total_queries) AS BIGINT) AS open_queries, count(*) AS patients
FROM elock GROUP BY study_id, site_id ORDER BY open_queries DESC, study_id, site_id LIMIT 20""")
def q_a70(spark, sf):
    return finalize(V.query_load(enhanced_record(spark, sf)))


@query("a71_readiness_by_status", ENH + """
SELECT subject_status_clean, count(*) AS patients, count(*) FILTER (WHERE dblock_status = 'Ready') AS ready,
  count(*) FILTER (WHERE dblock_status = 'Pending') AS pending, count(*) FILTER (WHERE dblock_status = 'Blocked') AS blocked,
  CAST(sum(dblock_blocker_count) AS BIGINT) AS blockers, CAST(sum(dblock_critical_count) AS BIGINT) AS critical_blockers
FROM elock WHERE dblock_eligible GROUP BY 1""")
def q_a71(spark, sf):
    return finalize(V.readiness_by_status(enhanced_record(spark, sf)))
