"""SQL (DuckDB dialect) building blocks for the oracle twins.

Written independently of the Spark operators: same definitions, SQL idiom.
"""
from __future__ import annotations

from quarry.sources.testmap import EVENT_PRED, LINE_PRED, ORDER_PRED, QUERY_KINDS

AS_OF_STAR = "DATE '2001-12-31'"


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def _any(d) -> str:
    return " OR ".join(f"({p})" for p in d.values())


SPINE = """
spine AS (
  SELECT c.c_custkey AS subject_key,
         'Study_' || CAST(r.r_regionkey AS VARCHAR) || '|' || 'Site_' || CAST(c.c_nationkey AS VARCHAR)
           || '|' || 'Subject_' || CAST(c.c_custkey AS VARCHAR) AS patient_key,
         'Study_' || CAST(r.r_regionkey AS VARCHAR) AS study_id,
         'Site_' || CAST(c.c_nationkey AS VARCHAR) AS site_id,
         'Subject_' || CAST(c.c_custkey AS VARCHAR) AS subject_id,
         r.r_name AS region, n.n_name AS country,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Ongoing' WHEN 'BUILDING' THEN 'Completed'
              WHEN 'FURNITURE' THEN 'Discontinued' WHEN 'HOUSEHOLD' THEN 'Screening'
              WHEN 'MACHINERY' THEN 'Screen Failure' ELSE 'Unknown' END AS subject_status_clean
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

_q = LINE_PRED["query"]
_kinds = ",\n    ".join(f"count(*) FILTER (WHERE ({_q}) AND ({p})) AS {n}" for n, p in QUERY_KINDS.items())
_pg, _cd, _ovd, _sdv = LINE_PRED["pages"], LINE_PRED["coding"], LINE_PRED["overdue_sig"], LINE_PRED["sdv"]


def _coding(dic: str, parity: int) -> str:
    w = f"({_cd}) AND l_linenumber % 2 = {parity}"
    return (f"count(*) FILTER (WHERE {w}) AS {dic}_coding_{dic}_total,\n"
            f"    count(*) FILTER (WHERE {w} AND l_returnflag <> 'N') AS {dic}_coding_{dic}_coded,\n"
            f"    count(*) FILTER (WHERE {w} AND l_returnflag = 'N') AS {dic}_coding_{dic}_uncoded")


LINE_AGG = f"""
line_agg AS (
  SELECT o.o_custkey AS subject_key,
    count(*) FILTER (WHERE {_q}) AS total_queries,
    {_kinds},
    count(*) FILTER (WHERE {_sdv}) AS crfs_require_verification_sdv,
    count(*) FILTER (WHERE ({_sdv}) AND l_returnflag <> 'R') AS forms_verified,
    count(*) FILTER (WHERE {LINE_PRED['never_signed']}) AS crfs_never_signed,
    count(*) FILTER (WHERE {LINE_PRED['broken_sig']}) AS broken_signatures,
    count(*) FILTER (WHERE ({_ovd}) AND age <= 45) AS crfs_overdue_for_signs_within_45_days_of_data_entry,
    count(*) FILTER (WHERE ({_ovd}) AND age > 45 AND age <= 90)
      AS crfs_overdue_for_signs_between_45_to_90_days_of_data_entry,
    count(*) FILTER (WHERE ({_ovd}) AND age > 90) AS crfs_overdue_for_signs_beyond_90_days_of_data_entry,
    count(*) FILTER (WHERE {_pg}) AS pages_missing_page_count,
    max(CAST(age AS DOUBLE)) FILTER (WHERE {_pg}) AS pages_pages_missing_max_days,
    avg(CAST(age AS DOUBLE)) FILTER (WHERE {_pg}) AS pages_pages_missing_avg_days,
    {_coding('meddra', 1)},
    {_coding('whodrug', 0)}
  FROM (SELECT *, date_diff('day', CAST(l_shipdate AS DATE), {AS_OF_STAR}) AS age
        FROM lineitem WHERE {_any(LINE_PRED)}) li
  JOIN orders o ON li.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey
)"""

_v, _s, _i = ORDER_PRED["visit"], ORDER_PRED["sae"], ORDER_PRED["inactivated"]


def _sae(kind: str, parity: int) -> str:
    w = f"({_s}) AND o_orderkey % 2 = {parity}"
    return (f"count(*) FILTER (WHERE {w}) AS sae_{kind}_sae_{kind}_total,\n"
            f"    count(*) FILTER (WHERE {w} AND o_orderstatus = 'P') AS sae_{kind}_sae_{kind}_pending,\n"
            f"    count(*) FILTER (WHERE {w} AND o_orderstatus = 'F') AS sae_{kind}_sae_{kind}_completed")


ORDER_AGG = f"""
order_agg AS (
  SELECT o_custkey AS subject_key,
    count(*) FILTER (WHERE {_v}) AS visit_missing_visit_count,
    max(CAST(age AS DOUBLE)) FILTER (WHERE {_v}) AS visit_visits_overdue_max_days,
    avg(CAST(age AS DOUBLE)) FILTER (WHERE {_v}) AS visit_visits_overdue_avg_days,
    {_sae('dm', 0)},
    {_sae('safety', 1)},
    count(*) FILTER (WHERE {_i}) AS inactivated_inactivated_form_count,
    count(DISTINCT o_orderkey % 7) FILTER (WHERE {_i}) AS inactivated_inactivated_unique_forms
  FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), {AS_OF_STAR}) AS age
        FROM orders WHERE {_any(ORDER_PRED)}) o
  GROUP BY o_custkey
)"""

EVENT_AGG = f"""
event_agg AS (
  SELECT user_id AS subject_key,
    count(*) FILTER (WHERE {EVENT_PRED['lab']}) AS lab_lab_issue_count,
    count(*) FILTER (WHERE {EVENT_PRED['edrr']}) AS edrr_edrr_issue_count
  FROM events WHERE {_any(EVENT_PRED)}
  GROUP BY user_id
)"""

COUNT_COLS = (["total_queries"] + list(QUERY_KINDS) + [
    "crfs_require_verification_sdv", "forms_verified", "crfs_never_signed", "broken_signatures",
    "crfs_overdue_for_signs_within_45_days_of_data_entry",
    "crfs_overdue_for_signs_between_45_to_90_days_of_data_entry",
    "crfs_overdue_for_signs_beyond_90_days_of_data_entry",
    "pages_missing_page_count", "pages_pages_missing_max_days", "pages_pages_missing_avg_days",
    "meddra_coding_meddra_total", "meddra_coding_meddra_coded", "meddra_coding_meddra_uncoded",
    "whodrug_coding_whodrug_total", "whodrug_coding_whodrug_coded", "whodrug_coding_whodrug_uncoded",
    "visit_missing_visit_count", "visit_visits_overdue_max_days", "visit_visits_overdue_avg_days",
    "sae_dm_sae_dm_total", "sae_dm_sae_dm_pending", "sae_dm_sae_dm_completed",
    "sae_safety_sae_safety_total", "sae_safety_sae_safety_pending", "sae_safety_sae_safety_completed",
    "inactivated_inactivated_form_count", "inactivated_inactivated_unique_forms",
    "lab_lab_issue_count", "edrr_edrr_issue_count"])
_fill = ",\n    ".join(f"coalesce({c}, 0) AS {c}" for c in COUNT_COLS)

JOINED = f"""
joined AS (
  SELECT s.*,
    {_fill}
  FROM spine s
  LEFT JOIN line_agg USING (subject_key)
  LEFT JOIN order_agg USING (subject_key)
  LEFT JOIN event_agg USING (subject_key)
)"""

RECORD = """
record AS (
  SELECT *,
    visit_missing_visit_count + pages_missing_page_count + lab_lab_issue_count + edrr_edrr_issue_count
      + sae_dm_sae_dm_pending + sae_safety_sae_safety_pending AS total_issues_all_sources,
    meddra_coding_meddra_total + whodrug_coding_whodrug_total AS total_coding_terms,
    meddra_coding_meddra_coded + whodrug_coding_whodrug_coded AS total_coded_terms,
    meddra_coding_meddra_uncoded + whodrug_coding_whodrug_uncoded AS total_uncoded_terms,
    CASE WHEN meddra_coding_meddra_total + whodrug_coding_whodrug_total > 0
         THEN least(greatest(CAST(meddra_coding_meddra_coded + whodrug_coding_whodrug_coded AS DOUBLE)
              / (meddra_coding_meddra_total + whodrug_coding_whodrug_total) * 100.0, 0.0), 100.0)
         ELSE 100.0 END AS coding_completion_rate,
    sae_dm_sae_dm_total + sae_safety_sae_safety_total AS total_sae_issues,
    sae_dm_sae_dm_pending + sae_safety_sae_safety_pending AS total_sae_pending,
    visit_missing_visit_count > 0 AS has_missing_visits,
    pages_missing_page_count > 0 AS has_missing_pages,
    lab_lab_issue_count > 0 AS has_lab_issues,
    edrr_edrr_issue_count > 0 AS has_edrr_issues,
    (CAST(visit_missing_visit_count = 0 AS DOUBLE) + CAST(pages_missing_page_count = 0 AS DOUBLE)
      + CAST(meddra_coding_meddra_uncoded + whodrug_coding_whodrug_uncoded = 0 AS DOUBLE)) / 3 * 100.0
      AS completeness_score,
    CASE WHEN t = 0 THEN 'Low' WHEN t <= 5 THEN 'Medium' WHEN t <= 20 THEN 'High'
         WHEN t > 20 THEN 'Critical' ELSE 'Unknown' END AS risk_level
  FROM (SELECT *, visit_missing_visit_count + pages_missing_page_count + lab_lab_issue_count
          + edrr_edrr_issue_count + sae_dm_sae_dm_pending + sae_safety_sae_safety_pending AS t FROM joined)
)"""

RECORD_CTES = ",".join([SPINE, LINE_AGG, ORDER_AGG, EVENT_AGG, JOINED, RECORD.replace(
    "FROM (SELECT *,", "FROM (SELECT *,")])


def with_record(*ctes: str) -> str:
    """`WITH <record ctes>, <extra ctes>` prefix."""
    extra = "".join("," + c for c in ctes)
    return "WITH " + RECORD_CTES + extra + "\n"


# D1 basic DQI over `record` (same rules, SQL form)
DQI = """
dqi_c AS (
  SELECT *,
    100.0 - least((sae_dm_sae_dm_pending + sae_safety_sae_safety_pending) * 15.0, 100.0) AS dqi_safety_raw,
    100.0 - least(greatest(total_queries, dm_queries + clinical_queries + medical_queries + safety_queries)
      * 3.0, 100.0) AS dqi_query_raw,
    100.0 - least((visit_missing_visit_count + pages_missing_page_count) * 8.0, 100.0) AS dqi_completeness_raw,
    coalesce(coding_completion_rate, 100.0) AS dqi_coding_raw,
    100.0 - least((lab_lab_issue_count + 0) * 10.0, 100.0) AS dqi_lab_raw,
    CASE WHEN crfs_require_verification_sdv > 0
         THEN least(greatest(CAST(forms_verified AS DOUBLE) / crfs_require_verification_sdv * 100.0, 0.0), 100.0)
         ELSE 100.0 END AS dqi_sdv_raw,
    100.0 - least((crfs_never_signed * 1.0 + broken_signatures * 2.0
      + crfs_overdue_for_signs_within_45_days_of_data_entry * 1.0
      + crfs_overdue_for_signs_between_45_to_90_days_of_data_entry * 1.5
      + crfs_overdue_for_signs_beyond_90_days_of_data_entry * 2.0) * 5.0, 100.0) AS dqi_signature_raw,
    100.0 - least(greatest(edrr_edrr_issue_count, 0) * 10.0, 100.0) AS dqi_edrr_raw
  FROM record
),
dqi_w AS (
  SELECT *,
    dqi_safety_raw * 0.25 AS dqi_safety_weighted, dqi_query_raw * 0.2 AS dqi_query_weighted,
    dqi_completeness_raw * 0.15 AS dqi_completeness_weighted, dqi_coding_raw * 0.12 AS dqi_coding_weighted,
    dqi_lab_raw * 0.1 AS dqi_lab_weighted, dqi_sdv_raw * 0.08 AS dqi_sdv_weighted,
    dqi_signature_raw * 0.05 AS dqi_signature_weighted, dqi_edrr_raw * 0.05 AS dqi_edrr_weighted
  FROM dqi_c
),
dqi AS (
  SELECT *,
    CASE WHEN dqi_score >= 95 THEN 'Pristine' WHEN dqi_score >= 85 THEN 'Excellent'
         WHEN dqi_score >= 75 THEN 'Good' WHEN dqi_score >= 65 THEN 'Fair' WHEN dqi_score >= 50 THEN 'Poor'
         WHEN dqi_score >= 25 THEN 'Critical' ELSE 'Emergency' END AS dqi_band
  FROM (SELECT *, least(greatest(dqi_safety_weighted + dqi_query_weighted + dqi_completeness_weighted
          + dqi_coding_weighted + dqi_lab_weighted + dqi_sdv_weighted + dqi_signature_weighted
          + dqi_edrr_weighted, 0.0), 100.0) AS dqi_score FROM dqi_w)
)"""

# D6 basic clean tiers over `dqi` (or record)
_T1 = [("no_missing_visits", "visit_missing_visit_count"), ("no_missing_pages", "pages_missing_page_count"),
       ("no_open_queries", "total_queries"), ("sdv_complete", "crfs_require_verification_sdv"),
       ("signatures_complete", "crfs_never_signed"), ("meddra_coded", "meddra_coding_meddra_uncoded"),
       ("whodrug_coded", "whodrug_coding_whodrug_uncoded")]
_T2 = [("no_lab_issues", "lab_lab_issue_count"), ("no_sae_dm_pending", "sae_dm_sae_dm_pending"),
       ("no_sae_safety_pending", "sae_safety_sae_safety_pending"), ("no_edrr_issues", "edrr_edrr_issue_count"),
       ("no_overdue_signatures", "crfs_overdue_for_signs_beyond_90_days_of_data_entry"),
       ("no_inactivated_forms", "inactivated_inactivated_form_count"), ("no_broken_signatures", "broken_signatures")]


def clean_cte(src: str = "dqi") -> str:
    t1 = ", ".join(f"coalesce({c}, 0) = 0 AS tier1_{n}" for n, c in _T1)
    t2 = ", ".join(f"coalesce({c}, 0) = 0 AS tier2_{n}" for n, c in _T2)
    t1_all = " AND ".join(f"tier1_{n}" for n, _ in _T1)
    t2_all = " AND ".join(f"tier2_{n}" for n, _ in _T2)
    t1_first = " ".join(f"WHEN NOT tier1_{n} THEN '{n}'" for n, _ in _T1)
    t2_first = " ".join(f"WHEN NOT tier2_{n} THEN '{n}'" for n, _ in _T2)
    t1_cnt = " + ".join(f"CAST(NOT tier1_{n} AS INTEGER)" for n, _ in _T1)
    t2_cnt = " + ".join(f"CAST(NOT tier2_{n} AS INTEGER)" for n, _ in _T2)
    return f"""
clean_a AS (SELECT *, {t1}, {t2} FROM {src}),
clean_b AS (
  SELECT *, ({t1_all}) AS tier1_clinical_clean, ({t1_all}) AND ({t2_all}) AS tier2_operational_clean,
    CASE {t1_first} ELSE NULL END AS tier1_blocking_reason,
    CASE WHEN NOT ({t1_all}) THEN 'Not Tier 1 Clean' {t2_first} ELSE NULL END AS tier2_blocking_reason,
    CAST({t1_cnt} AS BIGINT) AS tier1_failing_count, CAST({t2_cnt} AS BIGINT) AS tier2_failing_count
  FROM clean_a
),
clean AS (
  SELECT *, CASE WHEN tier1_failing_count = 2 AND NOT tier1_clinical_clean THEN '2 Issues to Tier 1'
                 WHEN tier1_failing_count = 1 AND NOT tier1_clinical_clean THEN '1 Issue to Tier 1'
                 WHEN tier1_clinical_clean AND tier2_failing_count = 1 AND NOT tier2_operational_clean
                   THEN '1 Issue to Tier 2'
                 WHEN tier2_operational_clean THEN 'Already Clean' ELSE 'Not Quick Win' END AS quick_win_category
  FROM clean_b
)"""


LOCK = """
lock_a AS (
  SELECT *, subject_status_clean IN ('Ongoing', 'Completed', 'Discontinued') AS db_lock_eligible,
    (sae_dm_sae_dm_pending > 0 OR sae_safety_sae_safety_pending > 0 OR crfs_never_signed > 0) AS lk_pending
  FROM clean
),
lock_b AS (
  SELECT *, db_lock_eligible AND tier2_operational_clean AND NOT lk_pending AS db_lock_tier1_ready FROM lock_a
),
lock AS (
  SELECT * EXCLUDE (lk_pending),
    db_lock_eligible AND tier1_clinical_clean AND NOT db_lock_tier1_ready AS db_lock_tier2_pending,
    db_lock_eligible AND NOT tier1_clinical_clean AS db_lock_not_ready,
    CASE WHEN db_lock_tier1_ready THEN 'Tier 1 - Ready'
         WHEN db_lock_eligible AND tier1_clinical_clean AND NOT db_lock_tier1_ready THEN 'Tier 2 - Pending'
         WHEN db_lock_eligible THEN 'Not Ready' ELSE 'Not Eligible' END AS db_lock_status,
    CAST(tier1_failing_count * 2 + tier2_failing_count AS DOUBLE) AS db_lock_effort_score
  FROM lock_b
)"""


def scored(*ctes: str) -> str:
    """record -> dqi -> clean -> lock, plus extra CTEs."""
    return with_record(DQI, clean_cte("dqi"), LOCK, *ctes)


# ----------------------------------------------------------- raw text extracts
def site_text(ck: str, nk: str) -> str:
    return (f"CASE {ck} % 4 WHEN 0 THEN 'Site ' || CAST({nk} AS VARCHAR) WHEN 1 THEN 'SITE-' || CAST({nk} AS VARCHAR) "
            f"WHEN 2 THEN 'site_' || CAST({nk} AS VARCHAR) ELSE CAST({nk} AS VARCHAR) END")


def subject_text(ck: str) -> str:
    return (f"CASE {ck} % 3 WHEN 0 THEN 'Subject ' || CAST({ck} AS VARCHAR) WHEN 1 THEN 'subj-' || CAST({ck} AS VARCHAR) "
            f"ELSE CAST({ck} AS VARCHAR) END")


DUCK_DATE_FORMATS = ["%Y-%m-%d", "%d-%b-%Y", "%d%b%Y", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S",
                     "%d-%b-%Y %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]


def std_study(s: str) -> str:
    d = f"regexp_extract({s}, '(\\d+)', 1)"
    return (f"CASE WHEN {s} IS NULL OR lower({s}) IN ('none', 'nan', '') THEN 'Unknown' "
            f"WHEN {d} <> '' THEN 'Study_' || {d} ELSE trim({s}) END")


def std_site(s: str) -> str:
    rest = f"regexp_replace(trim({s}), '^site[\\s_-]*', '', 'i')"
    return (f"CASE WHEN {s} IS NULL OR lower({s}) IN ('none', 'nan', '') OR trim({s}) = '' OR {rest} = '' THEN NULL "
            f"ELSE 'Site_' || {rest} END")


def std_subject(s: str) -> str:
    rest = f"regexp_replace(trim({s}), '^(subject|subj)[\\s_-]*', '', 'i')"
    return (f"CASE WHEN {s} IS NULL OR lower(trim({s})) IN ('none', 'nan', '', 'null') OR {rest} = '' THEN NULL "
            f"ELSE 'Subject_' || {rest} END")


def std_status(s: str) -> str:
    from quarry.config import SUBJECT_STATUS_MAPPING as M
    l_ = f"lower(trim({s}))"
    exact = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dict(M).items())
    part = " ".join(f"WHEN contains({l_}, '{k}') THEN '{v}'" for k, v in M)
    return (f"CASE WHEN {s} IS NULL OR {l_} IN ('none', 'nan', '') THEN 'Unknown' "
            f"ELSE coalesce(CASE {l_} {exact} END, CASE {part} ELSE 'Unknown' END) END")


def pkey(study: str, site: str, subj: str) -> str:
    return f"concat_ws('|', coalesce({study}, 'Unknown'), coalesce({site}, 'Unknown'), coalesce({subj}, 'Unknown'))"


RAW_CPID = """
raw_base AS (
  SELECT c.c_custkey AS ck, r.r_regionkey AS rk, c.c_nationkey AS nk, r.r_name, n.n_name, c.c_acctbal, c.c_mktsegment
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
raw_one AS (
  SELECT
    CASE ck % 3 WHEN 0 THEN 'Study ' || CAST(rk AS VARCHAR) WHEN 1 THEN 'STUDY-' || CAST(rk AS VARCHAR) || ' (EDC)'
         ELSE 'study_' || CAST(rk AS VARCHAR) END AS project_name,
    r_name AS region, n_name AS country, """ + site_text("ck", "nk") + """ AS site,
    CASE WHEN ck % 97 = 1 THEN 'Responsible LF for action'
         WHEN ck % 89 = 2 THEN CASE ck % 3 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' ELSE '' END
         ELSE """ + subject_text("ck") + """ END AS subject,
    CASE WHEN ck % 113 = 5 THEN 'TBD' ELSE CASE c_mktsegment
      WHEN 'AUTOMOBILE' THEN CASE WHEN ck % 2 = 0 THEN 'On Treatment' ELSE 'Active' END
      WHEN 'BUILDING' THEN CASE WHEN ck % 2 = 0 THEN 'Completed' ELSE 'finished' END
      WHEN 'FURNITURE' THEN CASE WHEN ck % 2 = 0 THEN 'Withdrawn' ELSE 'Discontinued early' END
      WHEN 'HOUSEHOLD' THEN CASE WHEN ck % 2 = 0 THEN 'Screening' ELSE 'screening' END
      WHEN 'MACHINERY' THEN CASE WHEN ck % 2 = 0 THEN 'Screen Fail' ELSE 'Screening Failure' END
      ELSE 'TBD' END END AS subject_status,
    CASE WHEN ck % 31 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS acct_balance,
    CASE ck % 8 """ + " ".join(
    f"WHEN {i} THEN strftime((DATE '1995-01-01' + CAST(ck % 2000 AS INTEGER)) + INTERVAL 630 MINUTE, '{f}')"
    for i, f in enumerate(DUCK_DATE_FORMATS[:-1])) + f""" ELSE strftime((DATE '1995-01-01' + CAST(ck % 2000 AS INTEGER))
      + INTERVAL 630 MINUTE, '{DUCK_DATE_FORMATS[-1]}') END AS latest_visit,
    ck
  FROM raw_base
),
raw_cpid AS (SELECT * EXCLUDE (ck) FROM raw_one UNION ALL SELECT * EXCLUDE (ck) FROM raw_one WHERE ck % 50 = 3)"""

JUNK_RE = "responsible|lf for action|site/cra|coder|safety team|investigator|cse/cdd|cdmd"
CLEAN_SUBJECTS = f"""
cs_a AS (
  SELECT * FROM raw_cpid
  WHERE NOT (coalesce(regexp_matches(lower(trim(project_name)), '{JUNK_RE}'), false)
          OR coalesce(regexp_matches(lower(trim(region)), '{JUNK_RE}'), false)
          OR coalesce(regexp_matches(lower(trim(country)), '{JUNK_RE}'), false)
          OR coalesce(regexp_matches(lower(trim(site)), '{JUNK_RE}'), false)
          OR coalesce(regexp_matches(lower(trim(subject)), '{JUNK_RE}'), false))
    AND subject IS NOT NULL AND subject NOT IN ('None', '', 'nan') AND length(subject) > 0
),
clean_subjects AS (
  SELECT DISTINCT {pkey(std_study('project_name'), std_site('site'), std_subject('subject'))} AS patient_key,
    {std_study('project_name')} AS study_id, {std_site('site')} AS site_id, {std_subject('subject')} AS subject_id,
    region, country, {std_status('subject_status')} AS subject_status_clean,
    coalesce(TRY_CAST(trim(acct_balance) AS DOUBLE), 0.0) AS acct_balance,
    coalesce({', '.join(f"try_strptime(trim(latest_visit), '{f}')" for f in DUCK_DATE_FORMATS)}) AS latest_visit
  FROM cs_a
)"""
