"""Segmentation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import segment
from quarry.plans import sqlbase as S
from quarry.plans.core import rec
from quarry.plans.registry import finalize, query

_cat = " ".join(f"WHEN subject_status_clean IN ({', '.join(repr(s) for s in sts)}) THEN '{c}'"
                for c, sts in config.STATUS_CATEGORIES)
_COH = {n: (f"subject_status_clean IN ({', '.join(repr(s) for s in sts)})"
            + {None: "", "has_issues": " AND total_issues_all_sources > 0", "has_sae": " AND total_sae_issues > 0"}[f])
        for n, sts, f in config.COHORTS}


@query("d15_d16_status_segments", S.with_record() + f"""
SELECT patient_key, subject_status_clean, CASE {_cat} ELSE NULL END AS status_category,
  subject_status_clean = 'Screen Failure' AS is_screen_failure,
  subject_status_clean NOT IN ('Unknown', 'Screening', 'Screen Failure') AS include_in_analysis,
  CASE WHEN subject_status_clean = 'Unknown' THEN 'Unknown Status' WHEN subject_status_clean = 'Screening'
       THEN 'Still Screening' WHEN subject_status_clean = 'Screen Failure' THEN 'Screen Failure' END
    AS analysis_exclusion_reason
FROM record""")
def q_d15(spark, sf):
    r = segment.tag_screen_failures(rec(spark, sf))
    return finalize(r.select("patient_key", "subject_status_clean",
                             segment.status_category(F.col("subject_status_clean")).alias("status_category"),
                             "is_screen_failure", "include_in_analysis", "analysis_exclusion_reason"))


_members = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _COH.items())
_prim = " ".join(f"WHEN {_COH[n]} THEN '{n}'" for n in config.COHORT_PRIORITY)


@query("d17_cohorts", S.with_record() + f"""
SELECT patient_key, array_to_string(list_filter([{_members}], lambda x: x IS NOT NULL), ',') AS cohort_list,
  CASE {_prim} ELSE 'unassigned' END AS primary_cohort
FROM record""")
def q_d17(spark, sf):
    r = segment.assign_cohorts(rec(spark, sf))
    return finalize(r.select("patient_key", F.array_join("cohorts", ",").alias("cohort_list"), "primary_cohort"))


@query("d18_segment_risk", S.with_record() + """
SELECT patient_key, total_issues_all_sources, CASE WHEN total_issues_all_sources >= 10 THEN 'Critical'
  WHEN total_issues_all_sources >= 5 THEN 'High' WHEN total_issues_all_sources >= 1 THEN 'Medium' ELSE 'Low' END
  AS segment_risk_level
FROM record""")
def q_d18(spark, sf):
    r = rec(spark, sf)
    return finalize(r.select("patient_key", "total_issues_all_sources",
                             segment.segment_risk(F.col("total_issues_all_sources")).alias("segment_risk_level")))


_seg_union = " UNION ALL ".join(
    ["SELECT 'Status' AS segment_type, subject_status_clean AS segment_name FROM record"]
    + [f"SELECT 'Category', '{c}' FROM record WHERE subject_status_clean IN ({', '.join(repr(s) for s in sts)})"
       for c, sts in config.STATUS_CATEGORIES]
    + ["SELECT 'Risk', risk_level FROM record WHERE risk_level IN ('Critical', 'High', 'Medium', 'Low')"]
    + [f"SELECT 'Cohort', '{n}' FROM record WHERE {c}" for n, c in _COH.items()]
    + ["SELECT 'DB Lock', CASE WHEN subject_status_clean IN ('Ongoing', 'Completed', 'Discontinued') THEN 'Eligible' "
       "ELSE 'Excluded' END FROM record"])


@query("a25_segment_summary", S.with_record(f"m AS ({_seg_union})") + """
SELECT segment_type, segment_name, count(*) AS patient_count,
  round(count(*) * 100.0 / (SELECT count(*) FROM record), 6) AS pct_of_total
FROM m GROUP BY ALL""")
def q_a25(spark, sf):
    return finalize(segment.segment_summary(rec(spark, sf)))
