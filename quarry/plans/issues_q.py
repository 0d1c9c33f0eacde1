"""Issue detection queries."""
from __future__ import annotations

from quarry import config
from quarry.operators import issues
from quarry.plans import sqlbase as S
from quarry.plans.cache import materialized_plan
from quarry.plans.core import rec
from quarry.plans.registry import finalize, query

T = issues.TYPES
M = issues.META


@materialized_plan
def issue_record(spark, sf):
    return issues.issue_pipeline(rec(spark, sf))


def _f(x):
    return repr(float(x))


_cnt = {
    "sae_dm_pending": "CAST(sae_dm_sae_dm_pending AS DOUBLE)",
    "sae_safety_pending": "greatest(CAST(sae_safety_sae_safety_total AS DOUBLE) - sae_safety_sae_safety_completed, 0.0)",
    "open_queries": "CAST(total_queries AS DOUBLE)",
    "high_query_volume": "CAST(total_queries AS DOUBLE)",
    "sdv_incomplete": "CAST(crfs_require_verification_sdv AS DOUBLE)",
    "signature_gaps": "CAST(" + " + ".join(c for c, _ in config.SIGNATURE_GAP_POINTS) + " AS DOUBLE)",
    "broken_signatures": "CAST(broken_signatures AS DOUBLE)",
    "meddra_uncoded": "CAST(meddra_coding_meddra_uncoded AS DOUBLE)",
    "whodrug_uncoded": "CAST(whodrug_coding_whodrug_uncoded AS DOUBLE)",
    "missing_visits": "CAST(visit_missing_visit_count AS DOUBLE)",
    "missing_pages": "CAST(pages_missing_page_count AS DOUBLE)",
    "lab_issues": "CAST(lab_lab_issue_count AS DOUBLE)",
    "edrr_issues": "CAST(edrr_edrr_issue_count AS DOUBLE)",
    "inactivated_forms": "CAST(inactivated_inactivated_form_count AS DOUBLE)",
}


def _sev(t):
    crit, pts = M[t][3], M[t][7]
    if t == "high_query_volume":
        base = f"greatest(count_{t} - {config.HIGH_QUERY_VOLUME}, 0.0) * {_f(pts)}"
    elif t == "signature_gaps":
        base = "(" + " + ".join(f"CAST({c} AS DOUBLE) * {_f(p)}" for c, p in config.SIGNATURE_GAP_POINTS) + ")"
    else:
        base = f"count_{t} * {_f(pts)}"
    return f"least({base} * {_f(crit)}, 100.0) * issue_{t}"


_sev_list = "[" + ", ".join(f"severity_{t}" for t in T) + "]"
_names = "[" + ", ".join(f"'{t}'" for t in T) + "]"
ISSUES = f"""
is_a AS (SELECT *, {', '.join(f'{_cnt[t]} AS count_{t}' for t in T)} FROM record),
is_b AS (SELECT *, {', '.join(f"CAST(count_{t} > {config.HIGH_QUERY_VOLUME if t == 'high_query_volume' else 0} AS INTEGER) AS issue_{t}" for t in T)} FROM is_a),
is_c AS (SELECT *, {' + '.join(f'issue_{t}' for t in T)} AS total_issues, {', '.join(f'{_sev(t)} AS severity_{t}' for t in T)} FROM is_b),
is_d AS (SELECT *, {' + '.join(f'severity_{t}' for t in T)} AS total_severity,
  least({' + '.join(f'severity_{t} * {_f(M[t][6] / 100.0)}' for t in T)}, 100.0) AS priority_score FROM is_c),
is_q AS (
  SELECT coalesce(quantile_cont(priority_score, 0.25), 5.0) AS p25, coalesce(quantile_cont(priority_score, 0.5), 10.0) AS p50,
    coalesce(quantile_cont(priority_score, 0.75), 25.0) AS p75, coalesce(quantile_cont(priority_score, 0.9), 50.0) AS p90
  FROM is_d WHERE total_issues > 0),
iss AS (
  SELECT d.*,
    CASE WHEN total_issues = 0 THEN 'none'
         WHEN issue_sae_dm_pending = 1 OR issue_sae_safety_pending = 1 OR priority_score >= p90 THEN 'critical'
         WHEN priority_score >= p75 OR total_issues >= 4 THEN 'high'
         WHEN priority_score >= p50 THEN 'medium'
         WHEN priority_score >= p25 OR total_issues > 0 THEN 'low' ELSE 'none' END AS priority_tier,
    CASE WHEN total_issues = 0 THEN 'none' ELSE {_names}[list_position({_sev_list}, greatest({', '.join(f'severity_{t}' for t in T)}))] END
      AS primary_issue,
    CASE WHEN total_issues = 0 THEN 0.0 ELSE greatest({', '.join(f'severity_{t}' for t in T)}) END AS primary_issue_severity
  FROM is_d d CROSS JOIN is_q)"""
_sla = " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.PRIORITY_SLA_DAYS.items())

_D24 = [f"issue_{t}" for t in T] + [f"count_{t}" for t in T] + ["total_issues"]
_D24_SQL = [f"CAST(issue_{t} AS BIGINT) AS issue_{t}" for t in T] + [S.r6(f"count_{t}", f"count_{t}") for t in T] + \
    ["CAST(total_issues AS BIGINT) AS total_issues", "CAST(total_issues > 0 AS BIGINT) AS has_any_issue"]


@query("d24_issue_detection", S.with_record(ISSUES) + f"SELECT patient_key, {', '.join(_D24_SQL)} FROM iss")
def q_d24(spark, sf):
    return finalize(issue_record(spark, sf).select("patient_key", *_D24, "has_any_issue"))


@query("d25_issue_severity", S.with_record(ISSUES) + "SELECT patient_key, " + ", ".join(
    [S.r6(f"severity_{t}", f"severity_{t}") for t in T] + [S.r6("total_severity", "total_severity")]) + " FROM iss")
def q_d25(spark, sf):
    return finalize(issue_record(spark, sf).select("patient_key", *[f"severity_{t}" for t in T], "total_severity"))


@query("d26_issue_priority", S.with_record(ISSUES) + f"""
SELECT patient_key, {S.r6('priority_score', 'priority_score')}, priority_tier, CAST(CASE priority_tier {_sla} END AS BIGINT) AS sla_days,
  primary_issue, {S.r6('primary_issue_severity', 'primary_issue_severity')}
FROM iss""")
def q_d26(spark, sf):
    return finalize(issue_record(spark, sf).select("patient_key", "priority_score", "priority_tier", "sla_days",
                                                   "primary_issue", "primary_issue_severity"))


_d38 = " UNION ALL ".join(
    f"SELECT patient_key, study_id, site_id, '{t}' AS issue_type, '{M[t][1]}' AS issue_name, '{M[t][2]}' AS category, "
    f"'{M[t][4]}' AS responsible, CAST({M[t][5]} AS BIGINT) AS sla_days, round(count_{t}, 6) AS issue_count, "
    f"round(severity_{t}, 6) AS severity FROM iss WHERE issue_{t} = 1" for t in T)


@query("d38_issue_rows", S.with_record(ISSUES) + _d38)
def q_d38(spark, sf):
    return finalize(issues.issue_rows(issue_record(spark, sf)))


_a53 = " UNION ALL ".join(f"SELECT '{t}' AS issue_type, '{M[t][1]}' AS issue_name, CAST(sum(issue_{t}) AS BIGINT) AS patients FROM iss"
                          for t in T)


@query("a53_issue_breakdown", S.with_record(ISSUES) + _a53)
def q_a53(spark, sf):
    return finalize(issues.issue_breakdown(issue_record(spark, sf)))
