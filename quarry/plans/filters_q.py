"""Filter / search / ordered-list queries and small report aggregates."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.functions.quantiles import exact_quantiles
from quarry import config
from quarry.operators import collab, filters as FL, issues as IS
from quarry.plans import sqlbase as S
from quarry.plans.collab_q import ALERTS_SQL, ESC_SQL, ISSUES_SQL, _alerts
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query
from quarry.plans.resolution_q import RECS_SQL, recs
from quarry.plans.scores_q import ENH, enhanced_record
from quarry.sources import testmap
from quarry.sources.tables import load

AS_OF = dt.datetime(2001, 12, 31)


@query("f1_f7_filters", ENH + """
SELECT patient_key, study_id, site_id, round(dqi_score, 6) AS dqi_score FROM elock
WHERE study_id IN ('Study_1', 'Study_3') AND subject_status_clean = 'Ongoing' AND dqi_score BETWEEN 80 AND 95""")
def q_f1(spark, sf):
    x = FL.where_all(enhanced_record(spark, sf), study_id=["Study_1", "Study_3"], subject_status_clean="Ongoing",
                     dqi_score__between=(80, 95))
    return finalize(x.select("patient_key", "study_id", "site_id", "dqi_score"))


@query("f3_escalation_search", "WITH " + ISSUES_SQL + "," + ESC_SQL + """
SELECT rule_id, CAST(level AS BIGINT) AS level, count(*) AS escalations FROM esc
WHERE level IN (2, 3) AND status IN ('open', 'in_progress') GROUP BY ALL""")
def q_f3(spark, sf):
    e = collab.escalation_candidates(testmap.issues(spark, sf), AS_OF)
    e = FL.where_all(e, level=[2, 3], status=["open", "in_progress"])
    return finalize(e.groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("escalations")))


@query("f8_high_priority", S.with_record(ISSUES) + """
SELECT patient_key, priority_tier, CAST(total_issues AS BIGINT) AS total_issues, round(priority_score, 6) AS priority_score FROM iss
WHERE priority_tier IN ('critical', 'high') OR total_issues > 3 ORDER BY priority_score DESC, patient_key ASC LIMIT 50""")
def q_f8(spark, sf):
    return finalize(FL.high_priority(issue_record(spark, sf)).select("patient_key", "priority_tier", "total_issues",
                                                                     "priority_score"))


@query("f10_recent_alerts", "WITH " + ALERTS_SQL + """
SELECT category, priority, count(*) AS alerts FROM alerts
WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 72 HOUR AND created_at < TIMESTAMP '2024-02-01 00:00:00' GROUP BY ALL""")
def q_f10(spark, sf):
    r = FL.recent(_alerts(spark, sf), "created_at", config.AS_OF_EVENTS, 72)
    return finalize(r.groupBy("category", "priority").agg(F.count(F.lit(1)).alias("alerts")))


@query("o1_site_queue_order", ENH + """
SELECT patient_key, site_id, round(dqi_score, 6) AS dqi_score FROM elock ORDER BY site_id, dqi_score, patient_key""")
def q_o1(spark, sf):
    return finalize(enhanced_record(spark, sf).select("patient_key", "site_id", "dqi_score")
                    .orderBy("site_id", "dqi_score", "patient_key"))


@query("o4_top_sites_for_issue", S.with_record(ISSUES) + """
SELECT study_id, site_id, round(sum(count_open_queries), 6) AS issue_count FROM iss GROUP BY ALL
ORDER BY issue_count DESC, study_id, site_id LIMIT 10""")
def q_o4(spark, sf):
    return finalize(FL.top_sites_for(issue_record(spark, sf), "open_queries"))


_W = {t[0]: t[6] for t in config.ISSUE_TYPES}
_WCASE = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in _W.items()) + " ELSE 1.0 END"


@query("o5_portfolio_opportunities", RECS_SQL + f"""
, s AS (SELECT site_id, issue_type, sum(issue_count) AS issue_count, count(*) AS patients FROM recs GROUP BY ALL)
SELECT site_id, issue_type, round(issue_count, 6) AS issue_count, patients, round(issue_count * {_WCASE}, 6) AS impact
FROM s ORDER BY issue_count * {_WCASE} DESC, site_id, issue_type LIMIT 20""")
def q_o5(spark, sf):
    return finalize(FL.opportunities(recs(spark, sf), _W))


_ORD = ["critical", "high", "medium", "low", "none"]


@query("o9_mapped_order", S.with_record(ISSUES) + f"""
SELECT patient_key, priority_tier, round(priority_score, 6) AS priority_score FROM iss
ORDER BY coalesce(CASE priority_tier {' '.join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(_ORD))} END, {len(_ORD)}),
  priority_score DESC, patient_key ASC LIMIT 25""")
def q_o9(spark, sf):
    x = FL.mapped_order(issue_record(spark, sf), "priority_tier", _ORD, F.col("priority_score").desc(), "patient_key", 25)
    return finalize(x.select("patient_key", "priority_tier", "priority_score"))


@query("o10_prefix_suggestions", """
SELECT word, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
WHERE starts_with(word, 'th') GROUP BY word ORDER BY uses DESC, word ASC LIMIT 10""")
def q_o10(spark, sf):
    return finalize(FL.prefix_suggestions(load(spark, sf, "benchmark", ["text"]), "th"))


@query("o11_pinned_first", "WITH " + ALERTS_SQL + """
SELECT alert_id, priority, created_at FROM alerts ORDER BY priority = 'urgent' DESC, created_at DESC, alert_id ASC LIMIT 20""")
def q_o11(spark, sf):
    a = _alerts(spark, sf)
    return finalize(FL.pinned_first(a, F.col("priority") == "urgent", "created_at", "alert_id", 20)
                    .select("alert_id", "priority", "created_at"))


@query("f4_audit_query", """
WITH e AS (SELECT event_id AS entry_id, ts AS timestamp, user_id AS actor_id, event_type FROM events),
flagged AS (SELECT event_id AS entry_id FROM events WHERE value > 300)
SELECT DISTINCT actor_id, event_type FROM e WHERE actor_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND event_type IN ('error', 'purchase')
  AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-25 00:00:00'
  AND entry_id IN (SELECT entry_id FROM flagged)""")
def q_f4(spark, sf):
    ev = load(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    e = ev.select(F.col("event_id").alias("entry_id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("actor_id"),
                  "event_type")
    flagged = ev.filter(F.col("value") > 300).select(F.col("event_id").alias("entry_id"))
    return finalize(FL.audit_query(e, flagged, [1, 2, 3, 5, 8, 13, 21, 34], ["error", "purchase"],
                                   dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25)))


_AUDIT = """
WITH ae AS (SELECT event_id AS entry_id, ts AS timestamp, user_id AS actor_id, event_type, CASE WHEN event_type = 'error' THEN 'system' ELSE 'user' END AS action_category, 'session' AS entity_type,
  'S' || CAST(user_id % 7 AS VARCHAR) AS entity_id, CASE WHEN value > 300 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS severity, event_type <> 'error' AS success,
  'c' || CAST(event_id % 97 AS VARCHAR) AS correlation_id FROM events),
af AS (SELECT event_id AS entry_id, 'part11' AS flag FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'gcp' FROM events WHERE event_id % 2 = 0),
ag AS (SELECT event_id AS entry_id, 'k' || CAST(CAST(props ->> '$.k' AS INTEGER) % 5 AS VARCHAR) AS tag FROM events UNION ALL SELECT event_id, 'all' FROM events)"""


def _audit_tables(spark, sf):
    ev = load(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    i = F.col("event_id").alias("entry_id")
    entries = ev.select(i, F.col("ts").alias("timestamp"), F.col("user_id").alias("actor_id"), "event_type", F.when(F.col("event_type") == "error", "system").otherwise("user").alias("action_category"),
                        F.lit("session").alias("entity_type"), F.concat(F.lit("S"), (F.col("user_id") % 7).cast("string")).alias("entity_id"),
                        F.when(F.col("value") > 300, "high").when(F.col("value") > 50, "medium").otherwise("low").alias("severity"), (F.col("event_type") != "error").alias("success"),
                        F.concat(F.lit("c"), (F.col("event_id") % 97).cast("string")).alias("correlation_id"))
    flags = ev.where("event_id % 3 = 0").select(i, F.lit("part11").alias("flag")).unionAll(ev.where("event_id % 2 = 0").select(i, F.lit("gcp").alias("flag")))
    k = F.get_json_object("props", "$.k").cast("int") % 5
    tags = ev.select(i, F.concat(F.lit("k"), k.cast("string")).alias("tag")).unionAll(ev.select(i, F.lit("all").alias("tag")))
    return entries, flags, tags


@query("f4_audit_search", _AUDIT + """,
hit AS (SELECT DISTINCT * FROM ae WHERE action_category = 'user' AND entity_type = 'session' AND severity = 'medium' AND success AND timestamp >= TIMESTAMP '2024-01-03 00:00:00'
  AND timestamp <= TIMESTAMP '2024-01-28 00:00:00' AND entry_id IN (SELECT entry_id FROM af WHERE flag = 'part11') AND entry_id IN (SELECT entry_id FROM ag WHERE tag = 'k2'))
SELECT *, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY timestamp DESC, entry_id LIMIT 20 OFFSET 10""")
def q_f4_search(spark, sf):
    entries, flags, tags = _audit_tables(spark, sf)
    return finalize(FL.audit_search(entries, flags, tags, action_category="user", entity_type="session", severity="medium", success=True, start=dt.datetime(2024, 1, 3), end=dt.datetime(2024, 1, 28),
                                    flag="part11", tag="k2", limit=20, offset=10))


@query("f4_audit_entity", _AUDIT + """,
hit AS (SELECT DISTINCT * FROM ae WHERE actor_id = 8 AND event_type = 'error' AND entity_id = 'S1')
SELECT *, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY timestamp DESC, entry_id LIMIT 100""")
def q_f4_entity(spark, sf):
    entries, _, _ = _audit_tables(spark, sf)
    return finalize(FL.audit_search(entries, actor_id=8, event_type="error", entity_id="S1"))


@query("a58_matches_and_effort", RECS_SQL + """
SELECT issue_type, count(*) AS matches, count(DISTINCT site_id) AS sites,
  round(sum(issue_count * CAST(estimated_effort_hours AS DOUBLE)), 6) AS total_effort_hours FROM recs GROUP BY 1""")
def q_a58(spark, sf):
    r = recs(spark, sf)
    return finalize(r.groupBy("issue_type").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("site_id").alias("sites"),
                                                F.sum(F.col("issue_count") * F.col("estimated_effort_hours")).alias("total_effort_hours")))


@query("a72_work_items", RECS_SQL + """
SELECT site_id, issue_type, count(*) AS items, count(*) FILTER (WHERE is_primary_issue) AS primary_items,
  round(sum(CAST(estimated_effort_hours AS DOUBLE)), 6) AS effort_hours FROM recs GROUP BY ALL""")
def q_a72(spark, sf):
    r = recs(spark, sf)
    return finalize(r.groupBy("site_id", "issue_type").agg(F.count(F.lit(1)).alias("items"),
                                                           F.count(F.when(F.col("is_primary_issue"), 1)).alias("primary_items"),
                                                           F.sum("estimated_effort_hours").alias("effort_hours")))


@query("a73_condition_rates", ENH + """
SELECT study_id, site_id, count(*) AS patients, round(avg(CAST(tier1_clean AS DOUBLE)) * 100, 6) AS tier1_rate,
  round(avg(CAST(dblock_tier1_ready AS DOUBLE)) * 100, 6) AS ready_rate,
  round(avg(CAST(total_issues_all_sources > 0 AS DOUBLE)) * 100, 6) AS with_issues_rate,
  count(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_or_critical,
  CASE GROUPING(study_id, site_id) WHEN 3 THEN 'overall' WHEN 1 THEN 'study' ELSE 'site' END AS level
FROM elock GROUP BY ROLLUP (study_id, site_id)""")
def q_a73(spark, sf):
    c = F.col
    r = enhanced_record(spark, sf).rollup("study_id", "site_id").agg(
        F.count(F.lit(1)).alias("patients"), (F.avg(c("tier1_clean").cast("double")) * 100).alias("tier1_rate"),
        (F.avg(c("dblock_tier1_ready").cast("double")) * 100).alias("ready_rate"),
        (F.avg((c("total_issues_all_sources") > 0).cast("double")) * 100).alias("with_issues_rate"),
        F.count(F.when(c("risk_level").isin("High", "Critical"), 1)).alias("high_or_critical"), F.grouping_id().alias("_g"))
    return finalize(r.withColumn("level", F.when(c("_g") == 3, "overall").when(c("_g") == 1, "study").otherwise("site")).drop("_g"))


@query("a74_forecast_inputs", S.with_record(ISSUES) + """
SELECT study_id, site_id, count(*) AS patients, round(avg(total_issues), 6) AS issues_mean,
  round(avg(CAST(priority_tier = 'critical' AS DOUBLE)), 6) AS critical_rate,
  CASE GROUPING(study_id, site_id) WHEN 3 THEN 'portfolio' WHEN 1 THEN 'study' ELSE 'site' END AS level
FROM iss GROUP BY ROLLUP (study_id, site_id)""")
def q_a74(spark, sf):
    c = F.col
    r = issue_record(spark, sf).rollup("study_id", "site_id").agg(
        F.count(F.lit(1)).alias("patients"), F.avg("total_issues").alias("issues_mean"),
        F.avg((c("priority_tier") == "critical").cast("double")).alias("critical_rate"), F.grouping_id().alias("_g"))
    return finalize(r.withColumn("level", F.when(c("_g") == 3, "portfolio").when(c("_g") == 1, "study").otherwise("site")).drop("_g"))


@query("m24_score_distribution", ENH + """
SELECT count(*) AS patients, round(quantile_cont(dqi_score, 0.5), 6) AS p50, round(quantile_cont(dqi_score, 0.1), 6) AS p10,
  round(quantile_cont(dqi_score, 0.05), 6) AS p05, round(quantile_cont(dqi_score, 0.01), 6) AS p01,
  count(*) FILTER (WHERE dqi_score < 75) AS below_75, count(*) FILTER (WHERE dqi_score < 50) AS below_50 FROM elock""")
def q_m24(spark, sf):
    e = enhanced_record(spark, sf)
    names = ("p50", "p10", "p05", "p01")
    q = exact_quantiles(e, ["dqi_score"], [0.5, 0.1, 0.05, 0.01])["dqi_score"]
    r = e.agg(F.count(F.lit(1)).alias("patients"), F.count(F.when(F.col("dqi_score") < 75, 1)).alias("below_75"),
              F.count(F.when(F.col("dqi_score") < 50, 1)).alias("below_50"))
    return finalize(r.select("patients", *[F.lit(v).cast("double").alias(n) for n, v in zip(names, q)], "below_75", "below_50"))
