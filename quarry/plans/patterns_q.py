"""Pattern library queries."""
from __future__ import annotations

from quarry import config
from quarry.operators import patterns as PT
from quarry.operators.issues import TYPES
from quarry.plans import sqlbase as S
from quarry.plans.cache import materialized_plan
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query


@materialized_plan
def site_patterns(spark, sf):
    return PT.detect(PT.site_base(issue_record(spark, sf)))


BASE_SQL = S.with_record(ISSUES) + f""",
sb AS (SELECT study_id, site_id, count(*) AS patient_count, sum(total_issues) AS total_issues,
  {', '.join(f'sum(count_{t}) AS count_{t}' for t in TYPES)},
  count(*) FILTER (WHERE priority_tier = 'critical') AS is_critical, count(*) FILTER (WHERE priority_tier = 'high') AS is_high
  FROM iss GROUP BY study_id, site_id),
st AS (SELECT study_id, sum(total_issues) / greatest(count(*), 1) AS sip FROM iss GROUP BY study_id),
s AS (SELECT sb.*, sb.total_issues / greatest(patient_count, 1) AS ipp, coalesce(st.sip, 0.0) AS sip,
  CAST(count_signature_gaps AS BIGINT) + CAST(count_broken_signatures AS BIGINT) AS sig, CAST(count_open_queries AS BIGINT) AS oq,
  CAST(count_open_queries AS BIGINT) / greatest(patient_count, 1) AS qpp,
  CAST(count_missing_visits AS BIGINT) + CAST(count_missing_pages AS BIGINT) AS miss,
  CAST(count_meddra_uncoded AS BIGINT) + CAST(count_whodrug_uncoded AS BIGINT) AS unc
  FROM sb LEFT JOIN st USING (study_id))"""
_RULES = [
    ("PAT-SP-001", "ipp > sip * 1.5 AND ipp > 2", "least(0.9, 0.5 + (ipp / greatest(sip, 0.1) - 1.5) * 0.2)"),
    ("PAT-SP-002", "ipp > 3 AND patient_count >= 3", "least(0.85, 0.5 + ipp * 0.1)"),
    ("PAT-RC-001", "patient_count > 25", "least(0.95, 0.6 + (patient_count - 25) * 0.01)"),
    ("PAT-RC-002", "sig > 10", "least(0.9, 0.5 + sig * 0.02)"),
    ("PAT-DQ-001", "qpp > 2 OR oq > 20", "least(0.85, 0.5 + qpp * 0.15)"),
    ("PAT-DQ-002", "CAST(count_sdv_incomplete AS BIGINT) > 20", "least(0.85, 0.5 + CAST(count_sdv_incomplete AS BIGINT) * 0.01)"),
    ("PAT-DQ-003", "miss > 5", "least(0.8, 0.5 + miss * 0.03)"),
    ("PAT-DQ-004", "unc > 5", "least(0.8, 0.5 + unc * 0.05)"),
    ("PAT-SF-001", "CAST(count_sae_dm_pending AS BIGINT) > 0", "least(0.95, 0.7 + CAST(count_sae_dm_pending AS BIGINT) * 0.1)"),
    ("PAT-SF-002", "CAST(count_sae_safety_pending AS BIGINT) > 0", "least(0.95, 0.7 + CAST(count_sae_safety_pending AS BIGINT) * 0.1)"),
    ("PAT-TL-001", "is_critical > 0 OR is_high > 3", "least(0.9, 0.6 + is_critical * 0.1 + is_high * 0.05)"),
    ("PAT-CP-001", "CAST(count_inactivated_forms AS BIGINT) > 10", "least(0.8, 0.5 + CAST(count_inactivated_forms AS BIGINT) * 0.02)"),
    ("PAT-CP-002", "CAST(count_edrr_issues AS BIGINT) > 0", "least(0.85, 0.6 + CAST(count_edrr_issues AS BIGINT) * 0.1)"),
]
_M = {p[0]: p for p in config.PATTERNS}
MATCH_SQL = BASE_SQL + ",\nmatches AS (" + " UNION ALL ".join(
    f"SELECT 'M-{pid}-' || site_id AS match_id, '{pid}' AS pattern_id, '{_M[pid][1]}' AS pattern_name, '{_M[pid][2]}' AS category, "
    f"'{_M[pid][3]}' AS severity, '{_M[pid][4]}' AS responsible_role, {_M[pid][5]} AS sla_days, study_id, site_id AS entity_id, "
    f"CAST({conf} AS DOUBLE) AS confidence FROM s WHERE {cond}" for pid, cond, conf in _RULES) + ")"


@query("d28_site_patterns", MATCH_SQL + """
SELECT match_id, pattern_id, pattern_name, category, severity, responsible_role, CAST(sla_days AS BIGINT) AS sla_days, study_id,
  entity_id, round(confidence, 6) AS confidence FROM matches""")
def q_d28(spark, sf):
    return finalize(site_patterns(spark, sf).drop("evidence"))


@query("d29_pattern_alerts", MATCH_SQL + """
SELECT match_id, pattern_id, entity_id, severity, responsible_role,
  '[' || upper(severity) || '] ' || pattern_name || ' at ' || entity_id AS alert_text,
  CAST(DATE '2001-12-31' + CAST(sla_days AS INTEGER) AS DATE) AS deadline FROM matches""")
def q_d29(spark, sf):
    return finalize(PT.alerts(site_patterns(spark, sf), config.AS_OF_STAR))


@query("a59_cross_study_validation", MATCH_SQL + f"""
SELECT pattern_id, count(*) AS occurrence_count, count(DISTINCT study_id) AS studies_affected, round(avg(confidence), 6) AS avg_confidence,
  count(DISTINCT study_id) >= {config.PATTERN_VALIDATION_MIN_STUDIES} AND avg(confidence) >= {config.PATTERN_VALIDATION_MIN_CONFIDENCE}
    AS cross_study_validated FROM matches GROUP BY pattern_id""")
def q_a59(spark, sf):
    return finalize(PT.cross_study_validation(site_patterns(spark, sf)))
