"""Rule queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import issues as IS
from quarry.operators import rules as RU
from quarry.plans.cascade_q import CASCADE_SQL, cascade_record
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH, enhanced_record
from quarry.sources.tables import load

_RATE = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in config.ISSUE_RESOLUTION_RATES.items()) + \
    f" ELSE {float(config.DEFAULT_RESOLUTION_RATE)!r} END"
_ROWS = " UNION ALL ".join(f"SELECT study_id, '{t}' AS issue_type, CAST(count_{t} AS DOUBLE) AS issue_count FROM iss WHERE issue_{t} = 1"
                           for t in IS.TYPES)
_DAYS = ", ".join(f"CAST(ceil(open_count / ({_RATE} * {m!r})) AS BIGINT) AS days_{n}" for n, m in config.SCENARIO_RATE_MULTIPLIERS.items())


@query("a66_days_to_clear", ENH + "," + ISSUES + f""",
ir AS ({_ROWS}),
g AS (SELECT study_id, issue_type, sum(issue_count) AS open_count FROM ir GROUP BY ALL),
d AS (SELECT study_id, issue_type, round(open_count, 6) AS open_count, {_DAYS} FROM g)
SELECT d.*, CAST(DATE '2001-12-31' + CAST(max(days_expected) OVER (PARTITION BY study_id) + {config.LOCK_BUFFER_DAYS} AS INTEGER)
  AS DATE) AS projected_lock_date FROM d""")
def q_a66(spark, sf):
    return finalize(RU.days_to_clear(IS.issue_rows(issue_record(spark, sf)), config.AS_OF_STAR))


def _steps_sql(x, steps):
    return "CASE " + " ".join(f"WHEN {x} > {thr} THEN {pts}" for thr, pts in steps) + " ELSE 0 END"


@query("d41_site_severity", CASCADE_SQL + "," + ISSUES + f""",
s AS (SELECT study_id, site_id, avg(dqi_score) AS dqi_mean, avg(dblock_days_to_ready) AS days_delayed FROM elock GROUP BY ALL),
c AS (SELECT study_id, site_id, count(*) FILTER (WHERE cascade_issue_count > 1) AS cascade_patients FROM cascade GROUP BY ALL),
i AS (SELECT study_id, site_id, count(*) FILTER (WHERE total_issues > 0) AS patients_affected,
  avg(CAST(priority_tier = 'critical' AS DOUBLE)) AS sla_breach_risk FROM iss GROUP BY ALL),
x AS (SELECT * FROM s JOIN c USING (study_id, site_id) JOIN i USING (study_id, site_id)),
y AS (SELECT *, 100.0 - dqi_mean AS loss, least(100.0, CAST(({_steps_sql('patients_affected', config.SEV_PATIENTS)})
  + ({_steps_sql('cascade_patients', config.SEV_CASCADE)}) + ({_steps_sql('100.0 - dqi_mean', config.SEV_DQI_LOSS)}) AS DOUBLE)
  + least({float(config.SEV_SLA_MAX)!r}, sla_breach_risk * {config.SEV_SLA_MAX}) + ({_steps_sql('coalesce(days_delayed, 0.0)', config.SEV_DELAY)}))
  AS severity_score FROM x)
SELECT study_id, site_id, patients_affected, cascade_patients, round(loss, 6) AS projected_dqi_loss,
  round(sla_breach_risk, 6) AS sla_breach_risk, round(days_delayed, 6) AS days_delayed, round(severity_score, 6) AS severity_score,
  CASE {' '.join(f"WHEN severity_score >= {t} THEN '{n}'" for t, n in config.SEV_LABELS)} ELSE 'Low' END AS severity_label
FROM y""")
def q_d41(spark, sf):
    return finalize(RU.site_severity(enhanced_record(spark, sf), cascade_record(spark, sf), issue_record(spark, sf)))


def _sites(spark, sf):
    n = load(spark, sf, "nation", ["n_nationkey"])
    return n.select(F.concat(F.lit("Site_"), F.col("n_nationkey").cast("string")).alias("site_id"),
                    (F.col("n_nationkey") % 7 != 0).alias("active"))


@query("d37_constraint_violations", ENH + "," + ISSUES + f""",
sites AS (SELECT 'Site_' || CAST(n_nationkey AS VARCHAR) AS site_id, n_nationkey % 7 <> 0 AS active FROM nation)
SELECT 'ready_requires_clean' AS constraint, 'hard' AS kind, patient_key AS entity_id FROM elock WHERE dblock_tier1_ready AND NOT tier2_clean
UNION ALL SELECT 'completed_no_critical', 'hard', patient_key FROM iss WHERE subject_status_clean = 'Completed' AND priority_tier = 'critical'
UNION ALL SELECT 'patient_dqi_min', 'soft', patient_key FROM elock WHERE dqi_score < {config.PATIENT_DQI_MIN}
UNION ALL SELECT 'site_mean_dqi_min', 'soft', study_id || '|' || site_id FROM elock GROUP BY study_id, site_id
  HAVING avg(dqi_score) < {config.SITE_MEAN_DQI_MIN}
UNION ALL SELECT 'no_orphan_patient', 'hard', patient_key FROM elock e WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.active AND s.site_id = e.site_id)""")
def q_d37(spark, sf):
    return finalize(RU.constraint_violations(enhanced_record(spark, sf), issue_record(spark, sf), _sites(spark, sf)))


@query("d44_goal_progress", ENH + """
SELECT study_id, site_id, count(*) AS target, count(*) FILTER (WHERE tier2_clean) AS current,
  round(CASE WHEN count(*) > 0 THEN least(100.0, count(*) FILTER (WHERE tier2_clean) / count(*) * 100.0) ELSE 0.0 END, 6) AS progress
FROM elock GROUP BY study_id, site_id""")
def q_d44(spark, sf):
    g = enhanced_record(spark, sf).groupBy("study_id", "site_id").agg(
        F.count(F.lit(1)).alias("target"), F.count(F.when(F.col("tier2_clean"), 1)).alias("current"))
    return finalize(g.withColumn("progress", RU.goal_progress(F.col("current"), F.col("target"))))
