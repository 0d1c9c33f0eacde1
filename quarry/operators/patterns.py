"""Site pattern library.

Each site row carries an array of the 13 rule results (match flag,
confidence, evidence); exploding the matched ones is the site x rule join
without a join, and the rule table never leaves the plan."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.issues import TYPES

META = {p[0]: p for p in config.PATTERNS}


def site_base(issues: DataFrame) -> DataFrame:
    """Per site patients, issue total, count_* sums, critical / high
    patient counts, issues per patient; per study issues per patient."""
    aggs = [F.count(F.lit(1)).alias("patient_count"), F.sum("total_issues").alias("total_issues"),
            *[F.sum(f"count_{t}").alias(f"count_{t}") for t in TYPES],
            F.count(F.when(F.col("priority_tier") == "critical", 1)).alias("is_critical"),
            F.count(F.when(F.col("priority_tier") == "high", 1)).alias("is_high")]
    s = issues.groupBy("study_id", "site_id").agg(*aggs)
    s = s.withColumn("issues_per_patient", F.col("total_issues") / F.greatest(F.col("patient_count"), F.lit(1)))
    st = issues.groupBy("study_id").agg((F.sum("total_issues") / F.greatest(F.count(F.lit(1)), F.lit(1)))
                                        .alias("study_issues_per_patient"))
    return s.join(st, "study_id", "left")


def detect(site: DataFrame) -> DataFrame:
    """(pattern, site) matches with confidence and numeric evidence."""
    c = F.col
    n, ipp, sip = c("patient_count"), c("issues_per_patient"), F.coalesce(c("study_issues_per_patient"), F.lit(0.0))
    cnt = lambda t: F.coalesce(c(f"count_{t}"), F.lit(0.0)).cast("long")
    sig = cnt("signature_gaps") + cnt("broken_signatures")
    oq = cnt("open_queries")
    qpp = oq / F.greatest(n, F.lit(1))
    miss = cnt("missing_visits") + cnt("missing_pages")
    unc = cnt("meddra_uncoded") + cnt("whodrug_uncoded")
    crit, high = c("is_critical"), c("is_high")

    def rule(pid, cond, conf, evidence):
        return F.struct(F.lit(pid).alias("pattern_id"), cond.alias("hit"), conf.cast("double").alias("confidence"),
                        F.create_map(*[x for k, v in evidence.items() for x in (F.lit(k), v.cast("double"))]).alias("evidence"))

    rules = [
        rule("PAT-SP-001", (ipp > sip * 1.5) & (ipp > 2),
             F.least(F.lit(0.9), F.lit(0.5) + (ipp / F.greatest(sip, F.lit(0.1)) - 1.5) * 0.2),
             {"issues_per_patient": ipp, "study_average": sip}),
        rule("PAT-SP-002", (ipp > 3) & (n >= 3), F.least(F.lit(0.85), F.lit(0.5) + ipp * 0.1),
             {"issues_per_patient": ipp, "patient_count": n}),
        rule("PAT-RC-001", n > 25, F.least(F.lit(0.95), F.lit(0.6) + (n - 25) * 0.01), {"patient_count": n}),
        rule("PAT-RC-002", sig > 10, F.least(F.lit(0.9), F.lit(0.5) + sig * 0.02),
             {"signature_gaps": cnt("signature_gaps"), "broken_signatures": cnt("broken_signatures")}),
        rule("PAT-DQ-001", (qpp > 2) | (oq > 20), F.least(F.lit(0.85), F.lit(0.5) + qpp * 0.15),
             {"open_queries": oq, "per_patient": qpp}),
        rule("PAT-DQ-002", cnt("sdv_incomplete") > 20, F.least(F.lit(0.85), F.lit(0.5) + cnt("sdv_incomplete") * 0.01),
             {"sdv_incomplete": cnt("sdv_incomplete")}),
        rule("PAT-DQ-003", miss > 5, F.least(F.lit(0.8), F.lit(0.5) + miss * 0.03),
             {"missing_visits": cnt("missing_visits"), "missing_pages": cnt("missing_pages")}),
        rule("PAT-DQ-004", unc > 5, F.least(F.lit(0.8), F.lit(0.5) + unc * 0.05),
             {"meddra_uncoded": cnt("meddra_uncoded"), "whodrug_uncoded": cnt("whodrug_uncoded")}),
        rule("PAT-SF-001", cnt("sae_dm_pending") > 0, F.least(F.lit(0.95), F.lit(0.7) + cnt("sae_dm_pending") * 0.1),
             {"sae_dm_pending": cnt("sae_dm_pending")}),
        rule("PAT-SF-002", cnt("sae_safety_pending") > 0,
             F.least(F.lit(0.95), F.lit(0.7) + cnt("sae_safety_pending") * 0.1), {"sae_safety_pending": cnt("sae_safety_pending")}),
        rule("PAT-TL-001", (crit > 0) | (high > 3), F.least(F.lit(0.9), F.lit(0.6) + crit * 0.1 + high * 0.05),
             {"critical_patients": crit, "high_priority_patients": high}),
        rule("PAT-CP-001", cnt("inactivated_forms") > 10, F.least(F.lit(0.8), F.lit(0.5) + cnt("inactivated_forms") * 0.02),
             {"inactivated_forms": cnt("inactivated_forms")}),
        rule("PAT-CP-002", cnt("edrr_issues") > 0, F.least(F.lit(0.85), F.lit(0.6) + cnt("edrr_issues") * 0.1),
             {"edrr_issues": cnt("edrr_issues")}),
    ]
    x = site.select("study_id", "site_id", F.explode(F.filter(F.array(*rules), lambda r: r["hit"])).alias("m"))
    meta = F.create_map(*[x for p in config.PATTERNS for x in (F.lit(p[0]), F.struct(
        F.lit(p[1]).alias("name"), F.lit(p[2]).alias("category"), F.lit(p[3]).alias("severity"),
        F.lit(p[4]).alias("role"), F.lit(p[5]).alias("sla_days")))])
    mm = meta[F.col("m.pattern_id")]
    return x.select(F.concat(F.lit("M-"), F.col("m.pattern_id"), F.lit("-"), F.col("site_id")).alias("match_id"),
                    F.col("m.pattern_id").alias("pattern_id"), mm["name"].alias("pattern_name"),
                    mm["category"].alias("category"), mm["severity"].alias("severity"),
                    mm["role"].alias("responsible_role"), mm["sla_days"].alias("sla_days"), "study_id",
                    F.col("site_id").alias("entity_id"), F.col("m.confidence").alias("confidence"),
                    F.col("m.evidence").alias("evidence"))


def alerts(matches: DataFrame, as_of: dt.date) -> DataFrame:
    """One alert per match, due as_of + SLA days."""
    return matches.select("match_id", "pattern_id", "entity_id", "severity", "responsible_role",
                          F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("pattern_name"), F.lit(" at "),
                                   F.col("entity_id")).alias("alert_text"),
                          F.date_add(F.lit(as_of), F.col("sla_days")).alias("deadline"))


def cross_study_validation(matches: DataFrame) -> DataFrame:
    """Per pattern matches, distinct studies, mean confidence; valid
    when seen in >= 2 studies with mean confidence >= 0.7."""
    g = matches.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("occurrence_count"),
                                          F.count_distinct("study_id").alias("studies_affected"),
                                          F.avg("confidence").alias("avg_confidence"))
    return g.withColumn("cross_study_validated",
                        (F.col("studies_affected") >= config.PATTERN_VALIDATION_MIN_STUDIES)
                        & (F.col("avg_confidence") >= config.PATTERN_VALIDATION_MIN_CONFIDENCE))


def cross_study_report(matches: DataFrame) -> DataFrame:
    """Matches by category and study: count, sites, mean confidence."""
    return matches.groupBy("category", "study_id").agg(F.count(F.lit(1)).alias("matches"),
                                                       F.count_distinct("entity_id").alias("sites"),
                                                       F.avg("confidence").alias("avg_confidence"))
