"""Rule operators over score tables: days to clear (A66), escalation
severity (D41), data-quality constraints (D37, J19), goal progress (D44)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config


def _steps(x: Column, steps) -> Column:
    expr = None
    for thr, pts in steps:
        expr = F.when(x > thr, F.lit(pts)) if expr is None else expr.when(x > thr, F.lit(pts))
    return expr.otherwise(F.lit(0))


def days_to_clear(issue_rows: DataFrame, as_of: dt.date) -> DataFrame:
    """Per study and issue type the open count and the days needed at
    the expected / best (x1.3) / worst (x0.6) daily rate (ceil), and the
    projected lock date = as_of + slowest type + 14 days buffer."""
    rate = F.create_map(*[x for k, v in config.ISSUE_RESOLUTION_RATES.items() for x in (F.lit(k), F.lit(float(v)))])
    g = issue_rows.groupBy("study_id", "issue_type").agg(F.sum("issue_count").alias("open_count"))
    r = F.coalesce(rate[F.col("issue_type")], F.lit(float(config.DEFAULT_RESOLUTION_RATE)))
    sel = [F.ceil(F.col("open_count") / (r * m)).cast("long").alias(f"days_{name}")
           for name, m in config.SCENARIO_RATE_MULTIPLIERS.items()]
    g = g.select("study_id", "issue_type", "open_count", *sel)
    mx = g.groupBy("study_id").agg(F.max("days_expected").alias("_mx"))
    g = g.join(mx, "study_id")
    return g.withColumn("projected_lock_date",
                        F.date_add(F.lit(as_of), (F.col("_mx") + config.LOCK_BUFFER_DAYS).cast("int"))).drop("_mx")


def site_severity(scored: DataFrame, cascade: DataFrame, issues: DataFrame) -> DataFrame:
    """D41 per site: patients with issues, cascade patients (2+ blocking
    issue types), projected DQI loss (100 - mean), SLA breach risk (share of
    critical-tier patients), days delayed (mean days to ready); stepped
    points, capped at 100, labelled."""
    s = scored.groupBy("study_id", "site_id").agg(F.avg("dqi_score").alias("dqi_mean"),
                                                  F.avg("dblock_days_to_ready").alias("days_delayed"))
    c = cascade.groupBy("study_id", "site_id").agg(F.count(F.when(F.col("cascade_issue_count") > 1, 1)).alias("cascade_patients"))
    i = issues.groupBy("study_id", "site_id").agg(F.count(F.when(F.col("total_issues") > 0, 1)).alias("patients_affected"),
                                                 F.avg((F.col("priority_tier") == "critical").cast("double")).alias("sla_breach_risk"))
    x = s.join(c, ["study_id", "site_id"]).join(i, ["study_id", "site_id"])
    loss = F.lit(100.0) - F.col("dqi_mean")
    score = (_steps(F.col("patients_affected"), config.SEV_PATIENTS) + _steps(F.col("cascade_patients"), config.SEV_CASCADE)
             + _steps(loss, config.SEV_DQI_LOSS)).cast("double") \
        + F.least(F.lit(float(config.SEV_SLA_MAX)), F.col("sla_breach_risk") * config.SEV_SLA_MAX) \
        + _steps(F.coalesce(F.col("days_delayed"), F.lit(0.0)), config.SEV_DELAY)
    x = x.withColumn("severity_score", F.least(F.lit(100.0), score))
    lab = None
    for thr, name in config.SEV_LABELS:
        lab = F.when(F.col("severity_score") >= thr, name) if lab is None else lab.when(F.col("severity_score") >= thr, name)
    return x.select("study_id", "site_id", "patients_affected", "cascade_patients", loss.alias("projected_dqi_loss"),
                    "sla_breach_risk", "days_delayed", "severity_score", lab.otherwise("Low").alias("severity_label"))


def constraint_violations(scored: DataFrame, issues: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per violation: ready => tier-2 clean (hard), completed =>
    no critical-tier issue (hard), patient DQI >= 50 (soft), site mean DQI >=
    75 (soft), patient at a missing or inactive site (hard, left anti join)."""
    c = F.col
    v1 = scored.filter(c("dblock_tier1_ready") & ~c("tier2_clean")).select(
        F.lit("ready_requires_clean").alias("constraint"), F.lit("hard").alias("kind"), c("patient_key").alias("entity_id"))
    v2 = issues.filter((c("subject_status_clean") == "Completed") & (c("priority_tier") == "critical")).select(
        F.lit("completed_no_critical").alias("constraint"), F.lit("hard").alias("kind"), c("patient_key").alias("entity_id"))
    v3 = scored.filter(c("dqi_score") < config.PATIENT_DQI_MIN).select(
        F.lit("patient_dqi_min").alias("constraint"), F.lit("soft").alias("kind"), c("patient_key").alias("entity_id"))
    site_mean = scored.groupBy("study_id", "site_id").agg(F.avg("dqi_score").alias("m"))
    v4 = site_mean.filter(c("m") < config.SITE_MEAN_DQI_MIN).select(
        F.lit("site_mean_dqi_min").alias("constraint"), F.lit("soft").alias("kind"),
        F.concat_ws("|", "study_id", "site_id").alias("entity_id"))
    active = sites.filter(c("active")).select("site_id")
    v5 = scored.select("patient_key", "site_id").join(active, "site_id", "left_anti").select(
        F.lit("no_orphan_patient").alias("constraint"), F.lit("hard").alias("kind"), c("patient_key").alias("entity_id"))
    return v1.unionByName(v2).unionByName(v3).unionByName(v4).unionByName(v5)


def goal_progress(current: Column, target: Column) -> Column:
    """min(100, current / target x 100); 0 when the target is 0."""
    return F.when(target > 0, F.least(F.lit(100.0), current / target * 100.0)).otherwise(0.0)
