"""Minimum slice: record, basic DQI, clean tiers, lock status, site
performance (SURVEY 7.2 step 1)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import clean, lock, record, rollups, scoring
from quarry.plans import sqlbase as S
from quarry.plans.cache import materialized_plan
from quarry.plans.registry import finalize, query

@materialized_plan
def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.build_record(spark, sf_dir)


@materialized_plan
def scored_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record -> D1 -> D6 -> D14, lazily; Catalyst prunes what a query does
    not read."""
    return lock.lock_basic(clean.clean_basic(scoring.dqi_basic(rec(spark, sf_dir))))


RECORD_COLS = ["patient_key", "study_id", "site_id", "subject_id", "region", "country", "subject_status_clean",
               *S.COUNT_COLS, "total_issues_all_sources", "total_coding_terms", "total_coded_terms",
               "total_uncoded_terms", "coding_completion_rate", "total_sae_issues", "total_sae_pending",
               "has_missing_visits", "has_missing_pages", "has_lab_issues", "has_edrr_issues",
               "completeness_score", "risk_level"]
_DOUBLE_RECORD = {"pages_pages_missing_max_days", "pages_pages_missing_avg_days", "visit_visits_overdue_max_days",
                  "visit_visits_overdue_avg_days", "coding_completion_rate", "completeness_score"}
_rec_sel = ", ".join(S.r6(c, c) if c in _DOUBLE_RECORD else c for c in RECORD_COLS)


@query("j4_record", S.with_record() + f"SELECT {_rec_sel} FROM record")
def q_record(spark, sf):
    return finalize(rec(spark, sf).select(*RECORD_COLS))


_DQI_COLS = [f"dqi_{k}_raw" for k in scoring.COMPONENTS] + ["dqi_score"]
_dqi_sel = ", ".join(S.r6(c, c) for c in _DQI_COLS)


@query("d1_dqi_basic", S.with_record(S.DQI) + f"SELECT patient_key, site_id, {_dqi_sel}, dqi_band FROM dqi")
def q_dqi(spark, sf):
    return finalize(scoring.dqi_basic(rec(spark, sf)).select("patient_key", "site_id", *_DQI_COLS, "dqi_band"))


_CLEAN_COLS = ["patient_key", "tier1_clinical_clean", "tier2_operational_clean", "tier1_blocking_reason",
               "tier2_blocking_reason", "tier1_failing_count", "tier2_failing_count", "quick_win_category"]


@query("d6_clean_basic", S.with_record(S.DQI, S.clean_cte("dqi")) + f"SELECT {', '.join(_CLEAN_COLS)} FROM clean")
def q_clean(spark, sf):
    return finalize(clean.clean_basic(rec(spark, sf)).select(*_CLEAN_COLS))


_LOCK_COLS = ["patient_key", "db_lock_eligible", "db_lock_tier1_ready", "db_lock_tier2_pending",
              "db_lock_not_ready", "db_lock_status", "db_lock_effort_score"]


@query("d14_lock_basic", S.scored() + f"SELECT {', '.join(_LOCK_COLS)} FROM lock")
def q_lock(spark, sf):
    return finalize(scored_record(spark, sf).select(*_LOCK_COLS))


SITE_SQL = S.scored("""
site_a AS (
  SELECT study_id, site_id, count(*) AS patient_count, avg(dqi_score) AS site_dqi_mean,
    min(dqi_score) AS site_dqi_min, max(dqi_score) AS site_dqi_max, stddev_samp(dqi_score) AS site_dqi_std,
    count(*) FILTER (WHERE tier1_clinical_clean) AS tier1_clean_count,
    count(*) FILTER (WHERE tier2_operational_clean) AS tier2_clean_count,
    count(*) FILTER (WHERE db_lock_tier1_ready) AS db_lock_ready_count,
    CAST(sum(total_queries) AS BIGINT) AS total_queries, CAST(sum(total_issues_all_sources) AS BIGINT) AS total_issues
  FROM lock GROUP BY study_id, site_id
),
site_b AS (
  SELECT *, round_even(tier1_clean_count / patient_count * 100.0, 1) AS tier1_clean_rate,
    round_even(tier2_clean_count / patient_count * 100.0, 1) AS tier2_clean_rate,
    round_even(db_lock_ready_count / patient_count * 100.0, 1) AS db_lock_ready_rate
  FROM site_a
),
site_c AS (
  SELECT *, round_even(least(greatest(site_dqi_mean * 0.4 + tier1_clean_rate * 0.3 + tier2_clean_rate * 0.2
    + db_lock_ready_rate * 0.1, 0.0), 100.0), 2) AS site_performance_index FROM site_b
)""") + """
SELECT study_id, site_id, patient_count, round(site_dqi_mean, 6) AS site_dqi_mean, round(site_dqi_min, 6) AS site_dqi_min,
  round(site_dqi_max, 6) AS site_dqi_max, round(site_dqi_std, 6) AS site_dqi_std, tier1_clean_count, tier2_clean_count,
  db_lock_ready_count, total_queries, total_issues, round(tier1_clean_rate, 6) AS tier1_clean_rate,
  round(tier2_clean_rate, 6) AS tier2_clean_rate, round(db_lock_ready_rate, 6) AS db_lock_ready_rate,
  round(site_performance_index, 6) AS site_performance_index,
  CASE WHEN site_performance_index >= 90 THEN 'Exceptional' WHEN site_performance_index >= 80 THEN 'Strong'
       WHEN site_performance_index >= 70 THEN 'Adequate' WHEN site_performance_index >= 60 THEN 'Needs Improvement'
       ELSE 'At Risk' END AS performance_tier
FROM site_c"""


@query("a8_site_performance", SITE_SQL)
def q_site(spark, sf):
    return finalize(rollups.site_performance(scored_record(spark, sf)))
