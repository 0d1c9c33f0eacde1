"""Boosted models and what they are worth on held-out rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import collab
from quarry.operators import ml as ML
from quarry.operators import models as MO
from quarry.operators.issues import TYPES
from quarry.plans.cache import shared_plan
from quarry.plans.core import rec
from quarry.plans.issues_q import issue_record
from quarry.plans.ml_q import RISK_ORDER
from quarry.plans.registry import finalize, query
from quarry.session import materialize_table
from quarry.sources import testmap

#: What the risk target is not made of.
RISK_FEATURES = ["dm_queries", "clinical_queries", "medical_queries", "site_queries", "crfs_require_verification_sdv", "forms_verified",
                 "crfs_overdue_for_signs_within_45_days_of_data_entry", "crfs_overdue_for_signs_between_45_to_90_days_of_data_entry", "visit_visits_overdue_avg_days",
                 "pages_pages_missing_avg_days", "whodrug_coding_whodrug_total", "whodrug_coding_whodrug_uncoded", "inactivated_inactivated_form_count", "edrr_edrr_issue_count"]
_CALCULATED = {"sae_dm_pending_calc": ["sae_dm_sae_dm_total", "sae_dm_sae_dm_completed"], "sae_safety_pending_calc": ["sae_safety_sae_safety_total", "sae_safety_sae_safety_completed"],
               "meddra_uncoded_calc": ["meddra_coding_meddra_total", "meddra_coding_meddra_coded"]}
TARGET_INPUTS = sorted({c for name, _, _ in config.RISK_TARGET_TERMS for c in _CALCULATED.get(name, [name])})
#: Nothing that is empty or zero exactly where an issue is absent (days overdue, pages missing for how long).
ISSUE_FEATURES = ["forms_verified", "dm_queries", "clinical_queries", "medical_queries", "meddra_coding_meddra_total", "whodrug_coding_whodrug_total",
                  "sae_dm_sae_dm_completed", "sae_safety_sae_safety_completed", "crfs_overdue_for_signs_within_45_days_of_data_entry"]


@shared_plan
def risk_classes(spark, sf):
    x = ML.risk_target(rec(spark, sf))
    return materialize_table(MO.risk_classifier(x, "patient_key", RISK_FEATURES, "risk_target", RISK_ORDER, TARGET_INPUTS), "risk-classes")


@query("m8_risk_classifier")
def q_m8(spark, sf):
    return finalize(risk_classes(spark, sf))


@query("m8_held_out_report")
def q_m8_report(spark, sf):
    """Precision, recall and F1 of each class on rows the model has not seen."""
    return finalize(ML.class_report(risk_classes(spark, sf).where("split = 'test'"), "label", "predicted"))


@query("m9_issue_classifiers")
def q_m9(spark, sf):
    i = issue_record(spark, sf)
    held = F.pmod(F.xxhash64("patient_key"), F.lit(5)) == 0
    return finalize(MO.issue_classifiers(i, "patient_key", ISSUE_FEATURES, [f"issue_{t}" for t in TYPES], held))


@shared_plan
def resolution(spark, sf):
    log = testmap.status_log(spark, sf)
    days = F.datediff(F.to_date("last_change"), F.to_date("first_change")).cast("double").alias("resolution_days")
    changes = log.groupBy("issue_id").agg(F.count("*").alias("changes"), F.count_distinct("status").alias("statuses"))
    code = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    x = testmap.issues(spark, sf).join(collab.current_state(log).select("issue_id", days), "issue_id").join(changes, "issue_id")
    x = x.select("issue_id", "resolution_days", "changes", "statuses", "amount", F.month("created_at").alias("month"), F.dayofweek("created_at").alias("weekday"),
                 code("priority", ["low", "medium", "high", "critical"]).alias("urgency"), code("category", TYPES).alias("kind"))
    held = F.pmod(F.col("issue_id"), F.lit(5)) == 0
    features = ["changes", "statuses", "amount", "month", "weekday", "urgency", "kind"]
    return materialize_table(MO.resolution_quantiles(x, "issue_id", features, "resolution_days", held), "resolution")


@query("m10_quantile_regression")
def q_m10(spark, sf):
    return finalize(resolution(spark, sf))


@query("m10_held_out_loss")
def q_m10_loss(spark, sf):
    """Pinball losses on held-out issues, coverage and width of the interval."""
    t = resolution(spark, sf).where("held_out")
    inside = (F.col("resolution_days") >= F.col("p10")) & (F.col("resolution_days") <= F.col("p90"))
    more = t.agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("p90") - F.col("p10")).alias("mean_width"))
    return finalize(MO.pinball(t, "resolution_days", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).crossJoin(more))
