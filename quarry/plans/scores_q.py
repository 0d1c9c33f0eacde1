"""Enhanced scores (D2-D5), enhanced clean (D7-D9), lock (D10-D13) and
their rollups (A11-A15)."""
from __future__ import annotations

from quarry import config
from quarry.operators import clean, lock, record, rollups, scoring
from quarry.plans import sqlbase as S
from quarry.plans.cache import materialized_plan
from quarry.plans.core import rec
from quarry.plans.registry import finalize, query

C = scoring.COMPONENTS


@materialized_plan
def enhanced_record(spark, sf):
    """record -> enhanced DQI -> enhanced clean -> lock readiness, written once."""
    return lock.lock_enhanced(clean.clean_enhanced(scoring.dqi_enhanced(rec(spark, sf))))


# the score table carries every DQI and clean column as well
edqi_record = enhanced_record
eclean_record = enhanced_record


def _f(x: float) -> str:
    return repr(float(x))


# ----------------------------------------------------------------- D2-D5 SQL
_cfg = {n: (w, cr, p) for n, w, cr, p in config.ENHANCED_DQI}
_sig_cols = [c for c, _ in config.SIGNATURE_SEVERITY]
_age = " ".join(f"WHEN visit_visits_overdue_avg_days >= {_f(lo)} THEN {_f(m)}"
                for lo, m in reversed(config.AGE_MULTIPLIERS))
_sev = " + ".join(f"(CASE WHEN {c} > 0 THEN {_f(p)} ELSE 0.0 END)" for c, p in config.SIGNATURE_SEVERITY)


def _pen(i, name, mult=""):
    _, cr, p = _cfg[name]
    return f"least(greatest(100.0 - least({i} * {_f(p)}{mult} * {_f(cr)}, 100.0), 0.0), 100.0)"


def _grade(col):
    return "CASE " + " ".join(f"WHEN {col} >= {t} THEN '{g}'" for t, g in config.GRADES) + \
        f" ELSE '{config.GRADE_FLOOR}' END"


_issue_list = "[" + ", ".join(f"i_{k}" for k in C) + "]"
_name_list = "[" + ", ".join(f"'{k}'" for k in C) + "]"
_worst_structs = "[" + ", ".join(f"{{'k': -i_{k}, 'o': {j}, 'n': '{k}', 'v': i_{k}}}" for j, k in enumerate(C)) + "]"
EDQI = f"""
edqi_a AS (
  SELECT *,
    CAST(sae_dm_sae_dm_pending + sae_safety_sae_safety_pending AS DOUBLE) AS i_safety,
    CAST(total_queries AS DOUBLE) AS i_query,
    CAST(visit_missing_visit_count + pages_missing_page_count AS DOUBLE) AS i_completeness,
    CAST(meddra_coding_meddra_uncoded + whodrug_coding_whodrug_uncoded AS DOUBLE) AS i_coding,
    CAST(lab_lab_issue_count AS DOUBLE) AS i_lab,
    CAST(crfs_require_verification_sdv AS DOUBLE) AS i_sdv,
    CASE WHEN greatest({', '.join(_sig_cols)}) > 0 THEN 1.0 ELSE 0.0 END AS i_signature,
    CAST(edrr_edrr_issue_count AS DOUBLE) AS i_edrr,
    CASE {_age} ELSE 1.0 END AS age_mult,
    {_sev} AS sig_sev
  FROM record
),
edqi_b AS (
  SELECT *,
    {_pen('i_safety', 'safety')} AS r_safety,
    {_pen('i_query', 'query')} AS r_query,
    {_pen('i_completeness', 'completeness', ' * age_mult')} AS r_completeness,
    least(greatest(coalesce(coding_completion_rate, 100.0), 0.0), 100.0) AS r_coding,
    {_pen('i_lab', 'lab')} AS r_lab,
    least(greatest(CASE WHEN crfs_require_verification_sdv + forms_verified > 0
      THEN CAST(forms_verified AS DOUBLE) / (crfs_require_verification_sdv + forms_verified) * 100.0
      ELSE 100.0 END, 0.0), 100.0) AS r_sdv,
    least(greatest(100.0 - least(sig_sev * {_f(_cfg['signature'][1])}, 100.0), 0.0), 100.0) AS r_signature,
    {_pen('i_edrr', 'edrr')} AS r_edrr
  FROM edqi_a
),
edqi AS (
  SELECT *,
    CASE WHEN dqi_score >= 95 THEN 'Pristine' WHEN dqi_score >= 85 THEN 'Excellent'
         WHEN dqi_score >= 75 THEN 'Good' WHEN dqi_score >= 65 THEN 'Fair' WHEN dqi_score >= 50 THEN 'Poor'
         WHEN dqi_score >= 25 THEN 'Critical' ELSE 'Emergency' END AS dqi_band,
    CASE WHEN dqi_score >= 85 THEN '🟢' WHEN dqi_score >= 65 THEN '🟡' WHEN dqi_score >= 50 THEN '🟠'
         ELSE '🔴' END AS dqi_band_icon,
    CASE WHEN greatest({', '.join(f'i_{k}' for k in C)}) > 0
         THEN {_name_list}[list_position({_issue_list}, greatest({', '.join(f'i_{k}' for k in C)}))]
         ELSE 'none' END AS dqi_primary_issue,
    coalesce(nullif(array_to_string(list_transform(list_slice(list_sort(list_filter({_worst_structs},
      lambda s: s.v > 0)), 1, 3), lambda s: s.n || ':' || CAST(CAST(s.v AS BIGINT) AS VARCHAR)), '; '), ''), 'none')
      AS dqi_worst_components,
    {', '.join(_grade(f'r_{k}') + f' AS dqi_{k}_grade' for k in C)}
  FROM (SELECT *, least(greatest({' + '.join(f'r_{k} * {_f(_cfg[k][0] / 100.0)}' for k in C)}, 0.0), 100.0)
          AS dqi_score FROM edqi_b)
)"""

_D2_COLS = ([f"dqi_{k}_raw" for k in C] + [f"dqi_{k}_issues" for k in C] + ["dqi_score", "dqi_band",
            "dqi_band_icon", "dqi_primary_issue", "dqi_worst_components"] + [f"dqi_{k}_grade" for k in C])
_d2_sel = ", ".join([S.r6(f"r_{k}", f"dqi_{k}_raw") for k in C] + [S.r6(f"i_{k}", f"dqi_{k}_issues") for k in C]
                    + [S.r6("dqi_score", "dqi_score"), "dqi_band", "dqi_band_icon", "dqi_primary_issue",
                       "dqi_worst_components"] + [f"dqi_{k}_grade" for k in C])


@query("d2_dqi_enhanced", S.with_record(EDQI) + f"SELECT patient_key, {_d2_sel} FROM edqi")
def q_d2(spark, sf):
    return finalize(edqi_record(spark, sf).select("patient_key", *_D2_COLS))


_A11_ROWS = " UNION ALL ".join(
    f"SELECT '{k}' AS component, {_f(_cfg[k][0])} AS weight, {_f(_cfg[k][1])} AS criticality, "
    f"count(*) FILTER (WHERE i_{k} > 0) AS patients_with_issues, CAST(sum(i_{k}) AS BIGINT) AS total_issues, "
    f"round(round_even(avg(r_{k}), 2), 6) AS avg_raw_score, round(round_even(min(r_{k}), 2), 6) AS min_raw_score, "
    f"round(round_even(max(r_{k}), 2), 6) AS max_raw_score, "
    f"round(round_even(avg(r_{k} * {_f(_cfg[k][0] / 100.0)}), 2), 6) AS contribution FROM edqi" for k in C)


@query("a11_dqi_component_summary", S.with_record(EDQI) + _A11_ROWS)
def q_a11(spark, sf):
    return finalize(scoring.dqi_component_summary(edqi_record(spark, sf)))


# ----------------------------------------------------------------- D7-D9 SQL
def _crit_sql(tier):
    return [(cid, col, hrs, prio) for t, cid, _, col, hrs, prio, _, _ in config.CLEAN_CRITERIA if t == tier]


_ce_a = []
for _t in (1, 2):
    for _cid, _col, _hrs, _ in _crit_sql(_t):
        _ce_a += [f"coalesce({_col}, 0) = 0 AS t{_t}_{_cid}", f"CAST(coalesce({_col}, 0) AS DOUBLE) AS t{_t}_{_cid}_count",
                  f"CASE WHEN coalesce({_col}, 0) = 0 THEN 0.0 ELSE CAST(coalesce({_col}, 0) AS DOUBLE) * {_f(_hrs)} END "
                  f"AS t{_t}_{_cid}_effort_hrs"]


def _tier_sql(t):
    cr = _crit_sql(t)
    passes = " AND ".join(f"t{t}_{c}" for c, *_ in cr)
    fails = " + ".join(f"CAST(NOT t{t}_{c} AS INTEGER)" for c, *_ in cr)
    effort = " + ".join(f"t{t}_{c}_effort_hrs" for c, *_ in cr)
    blocks = "[" + ", ".join(f"CASE WHEN NOT t{t}_{c} THEN {{'p': {p}, 'o': {i}, 'id': '{c}'}} END"
                             for i, (c, _, _, p) in enumerate(cr)) + "]"
    return (f"({passes}) AS _t{t}_pass, CAST({fails} AS BIGINT) AS tier{t}_failing_count, "
            f"{effort} AS tier{t}_effort_hours, ({effort}) / 8.0 AS tier{t}_effort_days, "
            f"list_sort(list_filter({blocks}, lambda x: x IS NOT NULL))[1].id AS _t{t}_primary")


_acts = "[" + ", ".join(
    f"CASE WHEN NOT t{t}_{cid} THEN {{'tier': {t}, 'prio': {p}, 'o': {i}, 'role': '{role}', 'name': '{name}', "
    f"'action': '{act}'}} END" for i, (t, cid, name, _, _, p, role, act) in enumerate(config.CLEAN_CRITERIA)) + "]"
ECLEAN = f"""
ec_a AS (SELECT *, {', '.join(_ce_a)} FROM edqi),
ec_b AS (SELECT *, {_tier_sql(1)}, {_tier_sql(2)} FROM ec_a),
ec_c AS (
  SELECT * EXCLUDE (_t1_pass, _t2_pass, _t1_primary, _t2_primary),
    _t1_pass AS tier1_clean, _t1_pass AND _t2_pass AS tier2_clean, _t1_primary AS tier1_primary_block,
    CASE WHEN NOT _t1_pass THEN 'Not Tier 1 Clean' ELSE _t2_primary END AS tier2_primary_block,
    tier1_effort_hours + tier2_effort_hours AS total_effort_hours,
    (tier1_effort_hours + tier2_effort_hours) / 8.0 AS total_effort_days,
    list_sort(list_filter({_acts}, lambda x: x IS NOT NULL)) AS _acts
  FROM ec_b
),
eclean AS (
  SELECT * EXCLUDE (_acts),
    CASE WHEN tier1_failing_count = 2 AND NOT tier1_clean THEN '2 Issues to Tier 1'
         WHEN tier1_failing_count = 1 AND NOT tier1_clean THEN '1 Issue to Tier 1'
         WHEN tier1_clean AND tier2_failing_count = 1 AND NOT tier2_clean THEN '1 Issue to Tier 2'
         WHEN tier2_clean THEN 'Already Clean'
         WHEN total_effort_hours > 0 AND total_effort_hours <= {_f(config.QUICK_WIN_MAX_HOURS)} THEN 'Low Effort (<4 hrs)'
         ELSE 'Not Quick Win' END AS quick_win_category,
    CASE WHEN tier1_failing_count = 2 AND NOT tier1_clean THEN 3
         WHEN tier1_failing_count = 1 AND NOT tier1_clean THEN 2
         WHEN tier1_clean AND tier2_failing_count = 1 AND NOT tier2_clean THEN 1
         WHEN tier2_clean THEN 0
         WHEN total_effort_hours > 0 AND total_effort_hours <= {_f(config.QUICK_WIN_MAX_HOURS)} THEN 4
         ELSE 999 END AS quick_win_priority,
    CASE WHEN len(_acts) = 0 THEN 'Clean - No actions needed'
         ELSE array_to_string(list_transform(list_slice(_acts, 1, 5), lambda a, i: CAST(i AS VARCHAR) || '. [' || a.role
              || '] ' || a.name || ': ' || a.action), ' | ') END AS path_to_clean,
    _acts[1].action AS next_action, _acts[1].role AS next_responsible
  FROM ec_c
)"""

_D7_COLS = ["patient_key", "tier1_clean", "tier2_clean", "tier1_failing_count", "tier2_failing_count",
            "tier1_effort_hours", "tier2_effort_hours", "total_effort_hours", "total_effort_days",
            "tier1_primary_block", "tier2_primary_block", "quick_win_category", "quick_win_priority",
            "is_quick_win", "path_to_clean", "next_action", "next_responsible"]
_D7_D = {"tier1_effort_hours", "tier2_effort_hours", "total_effort_hours", "total_effort_days"}
_d7_sel = ", ".join(S.r6(c, c) if c in _D7_D else ("quick_win_category <> 'Not Quick Win' AS is_quick_win"
                                                    if c == "is_quick_win" else c) for c in _D7_COLS)


@query("d7_clean_enhanced", S.with_record(EDQI, ECLEAN) + f"SELECT {_d7_sel} FROM eclean")
def q_d7(spark, sf):
    return finalize(eclean_record(spark, sf).select(*_D7_COLS))


# --------------------------------------------------------------- D10-D13 SQL
_lk_a = []
for _cid, _, _col, *_ in config.LOCK_CRITERIA:
    _lk_a += [f"coalesce({_col}, 0) = 0 AS dblock_{_cid}", f"CAST(coalesce({_col}, 0) AS DOUBLE) AS dblock_{_cid}_count"]
_all = " AND ".join(f"dblock_{c}" for c, *_ in config.LOCK_CRITERIA)
_ch = " AND ".join(f"dblock_{c}" for c, _, _, _, r, *_ in config.LOCK_CRITERIA if r <= 2)
_blk = "[" + ", ".join(f"CASE WHEN NOT dblock_{c} THEN {{'r': {r}, 'o': {i}, 'id': '{c}', 'name': '{n}', 'sev': '{s}'}} END"
                       for i, (c, n, _, s, r, _, _) in enumerate(config.LOCK_CRITERIA)) + "]"


def _days_term(cid, rd):
    n = f"greatest(1.0, least(dblock_{cid}_count, 100.0))"
    return (f"(CASE WHEN NOT dblock_{cid} THEN least(CASE WHEN {n} <= 5 THEN {n} * {_f(rd)} ELSE {_f(rd * 5)} + "
            f"{_f(rd * 0.5)} * ({n} - 5) END, 30.0) ELSE 0.0 END)")


_days = " + ".join(_days_term(c, rd) for c, _, _, _, _, rd, _ in config.LOCK_CRITERIA)
_cats = " ".join(f"WHEN dblock_days_to_ready <= {_f(t)} THEN '{lab}'" for t, lab in config.LOCK_DAYS_CATEGORIES[1:])
ELOCK = f"""
el_a AS (
  SELECT *, subject_status_clean IN ('Ongoing', 'Completed', 'Discontinued') AS dblock_eligible,
    CASE WHEN subject_status_clean IN ('Screen Failure', 'Screening', 'Unknown') THEN subject_status_clean END
      AS dblock_exclusion_reason,
    {', '.join(_lk_a)}
  FROM eclean
),
el_b AS (
  SELECT *, dblock_eligible AND {_all} AS dblock_tier1_ready,
    dblock_eligible AND {_ch} AND NOT (dblock_eligible AND {_all}) AS dblock_tier2_pending,
    list_sort(list_filter({_blk}, lambda x: x IS NOT NULL)) AS _b
  FROM el_a
),
el_c AS (
  SELECT * EXCLUDE (_b),
    dblock_eligible AND NOT dblock_tier1_ready AND NOT dblock_tier2_pending AS dblock_not_ready,
    CASE WHEN NOT dblock_eligible THEN 'Not Eligible' WHEN dblock_tier1_ready THEN 'Ready'
         WHEN dblock_tier2_pending THEN 'Pending' ELSE 'Blocked' END AS dblock_status,
    _b[1].id AS dblock_primary_blocker, _b[1].name AS dblock_primary_blocker_name,
    CAST(len(_b) AS BIGINT) AS dblock_blocker_count,
    CAST(len(list_filter(_b, lambda b: b.sev = 'Critical')) AS BIGINT) AS dblock_critical_count,
    CASE WHEN len(_b) = 0 THEN 'None' ELSE array_to_string(list_transform(list_slice(_b, 1, 5),
      lambda b: '[' || left(b.sev, 1) || '] ' || b.name), '; ') END AS dblock_blockers_list,
    CASE WHEN dblock_tier1_ready THEN 0.0 WHEN NOT dblock_eligible THEN NULL
         ELSE CAST(round_even(least(CAST(({_days}) AS DECIMAL(24,6)) * CAST({_f(config.LOCK_ESTIMATION_BUFFER)} AS DECIMAL(6,3)),
           CAST(90 AS DECIMAL(24,6))), 1) AS DOUBLE) END AS dblock_days_to_ready
  FROM el_b
),
elock AS (
  SELECT *, CASE WHEN dblock_days_to_ready IS NULL THEN 'Not Eligible' WHEN dblock_days_to_ready = 0 THEN 'Ready Now'
    {_cats} ELSE '>4 Weeks' END AS dblock_days_category
  FROM el_c
)"""

_D11_COLS = ["patient_key", "dblock_eligible", "dblock_exclusion_reason", "dblock_tier1_ready",
             "dblock_tier2_pending", "dblock_not_ready", "dblock_status", "dblock_primary_blocker",
             "dblock_primary_blocker_name", "dblock_blocker_count", "dblock_critical_count",
             "dblock_blockers_list", "dblock_days_to_ready", "dblock_days_category"]
_d11_sel = ", ".join(S.r6(c, c) if c == "dblock_days_to_ready" else c for c in _D11_COLS)
ENH = S.with_record(EDQI, ECLEAN, ELOCK)


@query("d11_lock_enhanced", ENH + f"SELECT {_d11_sel} FROM elock")
def q_d11(spark, sf):
    return finalize(enhanced_record(spark, sf).select(*_D11_COLS))


@query("a12_site_clean_summary", ENH + """
, a AS (
  SELECT study_id, site_id, count(*) AS patient_count, count(*) FILTER (WHERE tier1_clean) AS tier1_clean_count,
    count(*) FILTER (WHERE tier2_clean) AS tier2_clean_count, sum(tier1_effort_hours) AS tier1_effort_hours,
    sum(tier2_effort_hours) AS tier2_effort_hours, sum(total_effort_hours) AS total_effort_hours,
    count(*) FILTER (WHERE quick_win_category <> 'Not Quick Win') AS quick_win_count
  FROM elock GROUP BY study_id, site_id),
b AS (SELECT *, round_even(tier1_clean_count / patient_count * 100.0, 1) AS tier1_clean_rate,
        round_even(tier2_clean_count / patient_count * 100.0, 1) AS tier2_clean_rate,
        round_even(quick_win_count / patient_count * 100.0, 1) AS quick_win_rate FROM a),
c AS (SELECT *, CASE WHEN patient_count - tier2_clean_count > 0
          THEN round_even(total_effort_hours / (patient_count - tier2_clean_count), 2) ELSE 0.0 END AS avg_effort_per_patient,
        round_even(tier1_clean_rate * 0.4 + tier2_clean_rate * 0.4 + quick_win_rate * 0.2, 1) AS site_readiness_score FROM b)
SELECT study_id, site_id, patient_count, tier1_clean_count, tier2_clean_count, round(tier1_effort_hours, 6) AS tier1_effort_hours,
  round(tier2_effort_hours, 6) AS tier2_effort_hours, round(total_effort_hours, 6) AS total_effort_hours, quick_win_count,
  round(tier1_clean_rate, 6) AS tier1_clean_rate, round(tier2_clean_rate, 6) AS tier2_clean_rate,
  round(quick_win_rate, 6) AS quick_win_rate, round(avg_effort_per_patient, 6) AS avg_effort_per_patient,
  round(site_readiness_score, 6) AS site_readiness_score,
  CASE WHEN site_readiness_score >= 90 THEN 'Excellent' WHEN site_readiness_score >= 75 THEN 'Good'
       WHEN site_readiness_score >= 60 THEN 'Fair' WHEN site_readiness_score >= 40 THEN 'Needs Work' ELSE 'At Risk' END
    AS readiness_tier
FROM c""")
def q_a12(spark, sf):
    return finalize(rollups.site_clean_summary(enhanced_record(spark, sf)))


_a13 = " UNION ALL ".join(
    f"SELECT {t} AS tier, '{cid}' AS criterion_id, '{name}' AS name, '{'Hard Block' if t == 1 else 'Soft Block'}' AS block_type, "
    f"count(*) FILTER (WHERE NOT t{t}_{cid}) AS failures, "
    f"CAST(coalesce(sum(t{t}_{cid}_count) FILTER (WHERE NOT t{t}_{cid}{'' if t == 1 else ' AND tier1_clean'}), 0) AS BIGINT) AS total_issues, "
    f"round({'coalesce(sum(t%d_%s_effort_hrs), 0.0)' % (t, cid) if t == 1 else '0.0'}, 6) AS effort_hours, "
    f"{p} AS priority, '{role}' AS responsible, '{act}' AS action FROM elock"
    for t, cid, name, _, _, p, role, act in config.CLEAN_CRITERIA)


@query("a13_blocking_summary", ENH + _a13)
def q_a13(spark, sf):
    return finalize(rollups.blocking_summary(enhanced_record(spark, sf)))


@query("a14_study_lock_projection", ENH + """
, a AS (
  SELECT study_id, count(*) AS total_patients, count(*) FILTER (WHERE dblock_eligible) AS eligible,
    count(*) FILTER (WHERE dblock_tier1_ready) AS ready, count(*) FILTER (WHERE dblock_tier2_pending) AS pending,
    avg(dblock_days_to_ready) AS avg_days, quantile_cont(dblock_days_to_ready, 0.5) AS median_days,
    max(dblock_days_to_ready) AS max_days
  FROM elock GROUP BY study_id),
b AS (SELECT *, CASE WHEN eligible > 0 THEN round_even(ready / eligible * 100.0, 1) END AS ready_rate FROM a)
SELECT study_id, total_patients, eligible, ready, pending, round(avg_days, 6) AS avg_days, round(median_days, 6) AS median_days,
  round(max_days, 6) AS max_days, round(ready_rate, 6) AS ready_rate,
  CASE WHEN ready_rate IS NULL OR eligible = 0 THEN 'No Eligible Patients' WHEN ready_rate >= 95 THEN 'Lock Ready'
       WHEN ready_rate >= 80 THEN 'Near Ready' WHEN ready_rate >= 50 THEN 'In Progress' ELSE 'Not Ready' END AS lock_tier,
  TIMESTAMP '2001-12-31 00:00:00' + to_seconds(CAST(round(coalesce(max_days, 0.0) * 86400.0) AS BIGINT)) AS est_lock_date
FROM b""")
def q_a14(spark, sf):
    return finalize(rollups.study_lock_projection(enhanced_record(spark, sf), config.AS_OF_STAR))


@query("a15_site_lock_projection", ENH + """
, a AS (
  SELECT study_id, site_id, count(*) AS total_patients, count(*) FILTER (WHERE dblock_eligible) AS eligible,
    count(*) FILTER (WHERE dblock_tier1_ready) AS ready, avg(dblock_days_to_ready) AS avg_days,
    CAST(sum(dblock_blocker_count) AS BIGINT) AS total_blockers
  FROM elock GROUP BY study_id, site_id),
b AS (SELECT *, CASE WHEN eligible > 0 THEN round_even(ready / eligible * 100.0, 1) ELSE 100.0 END AS ready_rate FROM a)
SELECT study_id, site_id, total_patients, eligible, ready, round(avg_days, 6) AS avg_days, total_blockers,
  round(ready_rate, 6) AS ready_rate, round(100.0 - ready_rate, 6) AS priority_score
FROM b""")
def q_a15(spark, sf):
    return finalize(rollups.site_lock_projection(enhanced_record(spark, sf)))
