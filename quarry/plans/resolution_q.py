"""Resolution queries."""
from __future__ import annotations

from quarry import config
from quarry.operators import issues as IS
from quarry.operators import resolution as R
from quarry.plans import sqlbase as S
from quarry.plans.cache import materialized_plan
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query


@materialized_plan
def recs(spark, sf):
    return R.recommendations(IS.issue_rows(issue_record(spark, sf)))


_TPL_V = ", ".join(f"('{t}', '{it}', '{title}', '{role}', {eff!r}, 0.0, {i})"
                   for i, (t, it, title, role, eff) in enumerate(config.RESOLUTION_TEMPLATES))
_PRIO = "CASE issue_type " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(config.ISSUE_PRIORITY_ORDER)) + " ELSE 99 END"
_ROWS = " UNION ALL ".join(
    f"SELECT patient_key, study_id, site_id, '{t}' AS issue_type, CAST(count_{t} AS DOUBLE) AS issue_count FROM iss WHERE issue_{t} = 1"
    for t in IS.TYPES)
RECS_SQL = S.with_record(ISSUES) + f""",
tpl AS (SELECT * FROM (VALUES {_TPL_V}) t(template_id, issue_type, title, responsible_role, estimated_effort_hours, success_rate, ordinal)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_type ORDER BY success_rate DESC, estimated_effort_hours ASC,
  ordinal ASC) AS r FROM tpl) WHERE r = 1),
ir AS ({_ROWS}),
rk AS (SELECT *, row_number() OVER (PARTITION BY patient_key ORDER BY {_PRIO}, issue_type) AS issue_rank FROM ir),
recs AS (
  SELECT rk.patient_key, rk.study_id, rk.site_id, CAST(rk.issue_rank AS BIGINT) AS issue_rank, rk.issue_type, rk.issue_count,
    rk.issue_rank = 1 AS is_primary_issue, coalesce(b.template_id, 'GENERIC-001') AS template_id,
    CASE WHEN b.template_id IS NULL THEN 'Resolve ' || replace(rk.issue_type, '_', ' ') || ' issue' ELSE b.title END AS recommended_action,
    CASE WHEN b.template_id IS NULL THEN 'Data Manager' ELSE b.responsible_role END AS responsible_role,
    CASE WHEN b.template_id IS NULL THEN 0.5 ELSE b.estimated_effort_hours END AS estimated_effort_hours,
    CASE WHEN b.template_id IS NULL THEN 0.5 WHEN rk.issue_rank = 1 THEN 0.85 ELSE 0.75 END AS confidence
  FROM rk LEFT JOIN best b USING (issue_type))"""


@query("d30_w9_recommendations", RECS_SQL + """
SELECT patient_key, study_id, site_id, issue_rank, issue_type, round(issue_count, 6) AS issue_count, is_primary_issue, template_id,
  recommended_action, responsible_role, round(CAST(estimated_effort_hours AS DOUBLE), 6) AS estimated_effort_hours,
  round(CAST(confidence AS DOUBLE), 6) AS confidence FROM recs""")
def q_d30(spark, sf):
    return finalize(recs(spark, sf))


@query("a23_role_queue", RECS_SQL + """
SELECT responsible_role, count(*) AS task_count, round(sum(CAST(estimated_effort_hours AS DOUBLE)), 6) AS total_effort_hours,
  round(sum(CAST(estimated_effort_hours AS DOUBLE)) / count(*), 6) AS avg_effort_per_task FROM recs GROUP BY 1""")
def q_a23(spark, sf):
    return finalize(R.role_queue(recs(spark, sf)))


@query("a24_issue_type_summary", RECS_SQL + """
SELECT issue_type, count(DISTINCT patient_key) AS patient_count, min(template_id) AS primary_template_id,
  min(responsible_role) AS responsible_role, round(avg(CAST(estimated_effort_hours AS DOUBLE)), 6) AS avg_effort_hours,
  round(avg(CAST(confidence AS DOUBLE)), 6) AS avg_confidence FROM recs GROUP BY 1""")
def q_a24(spark, sf):
    return finalize(R.issue_summary(recs(spark, sf)))
