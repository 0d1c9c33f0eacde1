"""Activity, study and issue statistics (A9, A29, A34, A37, J6, J7, J9, P20, P23-P25,
W14, X9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import stats as ST
from quarry.operators import textops as TX
from quarry.plans.collab_q import ISSUES_SQL, LOG_SQL
from quarry.plans.core import rec
from quarry.plans.gov_q import PRED_SQL
from quarry.plans.issues_q import ISSUES as ISSUE_ROWS_SQL
from quarry.plans.issues_q import issue_record
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH, enhanced_record
from quarry.plans.text_q import SENT_SQL
from quarry.plans.trust_q import INTER_SQL
from quarry.sources import testmap
from quarry.sources.tables import load


def _audit(dimension: str, value: str) -> str:
    return (f"SELECT '{dimension}' AS dimension, CAST({value} AS VARCHAR) AS value, count(*) AS entries, "
            "count(*) FILTER (WHERE event_type <> 'error') AS successes FROM a GROUP BY 1, 2")


@query("a29_audit_statistics", f"""
WITH a AS (SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type = 'purchase' THEN 'warning' ELSE 'info' END AS severity FROM events),
u AS ({_audit('all', "'all'")} UNION ALL {_audit('event_type', 'event_type')} UNION ALL {_audit('severity', 'severity')}
  UNION ALL SELECT * FROM ({_audit('actor', 'user_id')} ORDER BY entries DESC, CAST(value AS BIGINT) LIMIT {ST.TOP_ACTORS}))
SELECT *, entries - successes AS failures, round(successes * 100.0 / entries, 6) AS success_rate FROM u""")
def q_a29(spark, sf):
    ev = load(spark, sf, "events", ["user_id", "event_type"])
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return finalize(ST.audit_statistics(ev.select("event_type", severity.alias("severity"), F.col("user_id").alias("actor_id"), (F.col("event_type") != "error").alias("success"))))


@query("a34_daily_usage", """
SELECT CAST(ts AS DATE) AS day, event_type AS feature, count(*) AS usage_count, count(DISTINCT user_id) AS unique_users FROM events GROUP BY ALL""")
def q_a34(spark, sf):
    ev = load(spark, sf, "events", ["ts", "user_id", "event_type"])
    return finalize(ST.daily_usage(ev.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("feature"), "user_id")))


@query("a37_feedback_summary", "WITH " + INTER_SQL + """,
g AS (SELECT coalesce(agent_name, 'all') AS agent_name, count(*) AS total, count(*) FILTER (WHERE outcome IN ('accepted', 'auto_executed')) AS accepts,
  count(*) FILTER (WHERE outcome = 'accepted_modified') AS modifies, count(*) FILTER (WHERE outcome = 'rejected') AS rejects,
  count(*) FILTER (WHERE outcome = 'overridden') AS overrides FROM x WHERE outcome IS NOT NULL GROUP BY ROLLUP (agent_name))
SELECT *, round((accepts + modifies) / total, 6) AS acceptance_rate, round(rejects / total, 6) AS rejection_rate, round(overrides / total, 6) AS override_rate FROM g""")
def q_a37(spark, sf):
    return finalize(ST.feedback_summary(testmap.interactions(spark, sf)))


@query("j9_outcomes_by_agent", "WITH " + PRED_SQL + """
SELECT action_type, agent_name, outcome_type, count(*) AS decisions FROM pred WHERE outcome_type IS NOT NULL GROUP BY ALL""")
def q_j9(spark, sf):
    p = testmap.predictions(spark, sf)
    outcomes = p.where("outcome_type IS NOT NULL").select("prediction_id", "outcome_type")
    return finalize(ST.outcomes_by_agent(p.drop("outcome_type"), outcomes))


@query("p20_winsorised", """
WITH l AS (SELECT 2 * quantile_cont(CAST(l_quantity AS DOUBLE), 0.25) AS "limit" FROM lineitem),
x AS (SELECT l_returnflag AS grp, "limit", CAST(l_quantity AS DOUBLE) AS v, greatest(0.0, least(CAST(l_quantity AS DOUBLE), "limit")) AS c FROM lineitem, l)
SELECT grp, round("limit", 6) AS "limit", round(avg(v), 6) AS mean_before, round(avg(c), 6) AS mean_after, round(max(c), 6) AS max_after,
  count(*) FILTER (WHERE v <> c) AS clipped FROM x GROUP BY ALL""")
def q_p20(spark, sf):
    li = load(spark, sf, "lineitem", ["l_returnflag", "l_quantity"])
    return finalize(ST.winsorised(li.select(F.col("l_returnflag").alias("grp"), "l_quantity"), "l_quantity", "grp", q=0.25))


_KW = ", ".join(f"CAST(contains(lower(category || ' ' || title), '{k}') AS INTEGER) AS {n}" for k, n in ST.ISSUE_KEYWORDS.items())


@query("p23_p25_issue_features", "WITH " + ISSUES_SQL + "," + LOG_SQL + f""",
l AS (SELECT issue_id, max(ts) AS answered_at FROM slog GROUP BY 1),
x AS (SELECT issue_id, isodow(created_at) - 1 AS open_day_of_week, hour(CAST(created_at AS TIMESTAMP)) AS open_hour, month(created_at) AS open_month,
  day(created_at) AS dom, quarter(created_at) AS q, {_KW}, date_diff('day', CAST(created_at AS DATE), CAST(answered_at AS DATE)) AS d FROM issues LEFT JOIN l USING (issue_id))
SELECT issue_id, open_day_of_week, open_hour, open_month, CAST(open_day_of_week >= 5 AS INTEGER) AS open_is_weekend,
  CAST(open_day_of_week = 0 AS INTEGER) AS open_is_monday, CAST(open_day_of_week = 4 AS INTEGER) AS open_is_friday,
  CAST(dom >= 25 AS INTEGER) AS open_is_end_of_month, CAST(dom <= 5 AS INTEGER) AS open_is_start_of_month,
  CAST(open_month IN (11, 12, 1) AS INTEGER) AS open_is_holiday_season, CAST(open_month IN (6, 7, 8) AS INTEGER) AS open_is_summer,
  CAST(q = 4 AS INTEGER) AS open_is_q4, CAST(q = 1 AS INTEGER) AS open_is_q1, {', '.join(ST.ISSUE_KEYWORDS.values())},
  CASE WHEN d >= 0 THEN d END AS resolution_days,
  CASE WHEN d < 0 THEN NULL WHEN d <= {ST.SHORT_DAYS} THEN 0 WHEN d <= {ST.MEDIUM_DAYS} THEN 1 WHEN d > {ST.MEDIUM_DAYS} THEN 2 END AS duration_class
FROM x""")
def q_p23(spark, sf):
    return finalize(ST.issue_features(testmap.issues(spark, sf), testmap.status_log(spark, sf)))


@query("w14_sentence_context", "WITH " + SENT_SQL + """,
n AS (SELECT *, lag(sentence) OVER w AS b, lead(sentence) OVER w AS a FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx, sent_idx))
SELECT doc_id, CAST(para_idx AS BIGINT) AS para_idx, CAST(sent_idx AS BIGINT) AS sent_idx, md5(concat_ws(' ', b, sentence, a)) AS context_md5 FROM n""")
def q_w14(spark, sf):
    s = TX.sentences(load(spark, sf, "documents", ["doc_id", "text"]))
    x = ST.with_neighbours(s, "doc_id", ["para_idx", "sent_idx"], "sentence")
    return finalize(x.select("doc_id", "para_idx", "sent_idx", F.md5("context").alias("context_md5")))


@query("x9_issue_timeline", "WITH " + ISSUES_SQL + "," + LOG_SQL + """,
t AS (SELECT issue_id, CAST(created_at AS TIMESTAMP) AS ts, 0 AS entry, 'created' AS event, status FROM issues
  UNION ALL SELECT issue_id, CAST(ts AS TIMESTAMP), seq, 'status_changed', status FROM slog)
SELECT issue_id, CAST(ts AS DATE) AS day, event, status, row_number() OVER (PARTITION BY issue_id ORDER BY ts, entry, status) AS position FROM t""")
def q_x9(spark, sf):
    t = ST.issue_timeline(testmap.issues(spark, sf), testmap.status_log(spark, sf))
    return finalize(t.select("issue_id", F.to_date("ts").alias("day"), "event", "status", "position"))


@query("j6_study_metrics", ENH + "," + ISSUE_ROWS_SQL + """,
pt AS (SELECT study_id, count(*) AS patients FROM record GROUP BY 1),
sm AS (SELECT study_id, site_id, avg(dqi_score) AS m FROM elock GROUP BY ALL),
si AS (SELECT study_id, count(*) AS sites, min(m) AS worst_site_dqi, count(*) FILTER (WHERE m < 90) AS low_sites FROM sm GROUP BY 1),
dq AS (SELECT study_id, avg(dqi_score) AS mean_dqi FROM elock GROUP BY 1),
cl AS (SELECT study_id, avg(CAST(tier1_clean AS DOUBLE)) * 100 AS tier1_rate, avg(CAST(tier2_clean AS DOUBLE)) * 100 AS tier2_rate FROM elock GROUP BY 1),
lo AS (SELECT study_id, count(*) FILTER (WHERE dblock_tier1_ready) AS lock_ready, count(*) FILTER (WHERE dblock_eligible) AS lock_eligible FROM elock GROUP BY 1),
ti AS (SELECT study_id, sum(total_issues) AS total_issues FROM iss GROUP BY 1)
SELECT study_id, patients, coalesce(sites, 0) AS sites, round(coalesce(worst_site_dqi, 0), 6) AS worst_site_dqi, coalesce(low_sites, 0) AS low_sites,
  round(coalesce(mean_dqi, 0), 6) AS mean_dqi, round(coalesce(tier1_rate, 0), 6) AS tier1_rate, round(coalesce(tier2_rate, 0), 6) AS tier2_rate,
  coalesce(lock_ready, 0) AS lock_ready, coalesce(lock_eligible, 0) AS lock_eligible, CAST(coalesce(total_issues, 0) AS BIGINT) AS total_issues,
  round(CASE WHEN lock_eligible > 0 THEN lock_ready * 100.0 / lock_eligible ELSE 0.0 END, 6) AS lock_rate
FROM pt LEFT JOIN si USING (study_id) LEFT JOIN dq USING (study_id) LEFT JOIN cl USING (study_id) LEFT JOIN lo USING (study_id) LEFT JOIN ti USING (study_id)""")
def q_j6(spark, sf):
    e = enhanced_record(spark, sf)
    return finalize(ST.study_metrics(rec(spark, sf), e, e, e, issue_record(spark, sf)))


@query("j7_region_lookup", ENH + """,
m AS (SELECT site_id, count(*) AS patients, avg(dqi_score) AS dqi_mean FROM elock GROUP BY 1),
k AS (SELECT site_id, min(region) AS region FROM elock GROUP BY 1)
SELECT coalesce(region, 'Unknown') AS region, count(*) AS sites, CAST(sum(patients) AS BIGINT) AS patients, round(avg(dqi_mean), 6) AS mean_of_sites
FROM m LEFT JOIN k ON k.site_id = m.site_id GROUP BY 1""")
def q_j7(spark, sf):
    e = enhanced_record(spark, sf)
    sites = e.groupBy("site_id").agg(F.count("*").alias("patients"), F.avg("dqi_score").alias("dqi_mean"))
    return finalize(ST.by_region(sites, e.select("site_id", "region").distinct()))
