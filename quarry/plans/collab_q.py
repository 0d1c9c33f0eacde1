"""Issue registry, escalation and alert queries (F2, F5, F6, D40, J13, A26-A28,
T1-T6, T10, P30)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import alerts as AL
from quarry.operators import collab
from quarry.plans import sqlbase as S
from quarry.plans.registry import finalize, query
from quarry.sources import testmap

AS_OF = dt.datetime(2001, 12, 31)
AS_OF_EV = config.AS_OF_EVENTS


def _case(col, mapping, default):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


_TYPES = [t[0] for t in config.ISSUE_TYPES]
ISSUES_SQL = f"""
issues AS (
  SELECT o_orderkey AS issue_id, o_custkey AS subject_key,
    [{', '.join(repr(t) for t in _TYPES)}][CAST(o_orderkey % {len(_TYPES)} + 1 AS INTEGER)] AS category,
    {_case('o_orderpriority', testmap.ORDER_ISSUE_PRIORITY, 'low')} AS priority,
    {_case('o_orderstatus', testmap.ORDER_ISSUE_STATUS, 'open')} AS status,
    o_orderdate AS created_at, 'Issue ' || CAST(o_orderkey AS VARCHAR) AS title, o_custkey % 50 AS assignee_id,
    o_totalprice AS amount
  FROM orders)"""
_SLA = "CASE priority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.SLA_HOURS.items()) + " ELSE 72 END"
_NOW = "TIMESTAMP '2001-12-31 00:00:00'"
SLA_SQL = f"""
sla AS (
  SELECT *, {_SLA} AS sla_hours, created_at + to_hours(CAST({_SLA} AS BIGINT)) AS due_date FROM issues),
sla2 AS (
  SELECT *, status NOT IN ('resolved', 'closed', 'cancelled') AND {_NOW} > due_date AS is_overdue,
    (epoch_us({_NOW}) - epoch_us(created_at)) / 3600000000.0 AS age_hours,
    greatest((epoch_us(due_date) - epoch_us({_NOW})) / 3600000000.0, 0.0) AS hours_remaining FROM sla)"""


@query("d40_issue_sla", "WITH " + ISSUES_SQL + "," + SLA_SQL + """
SELECT issue_id, priority, status, CAST(sla_hours AS BIGINT) AS sla_hours, due_date, is_overdue,
  round(age_hours, 6) AS age_hours, round(hours_remaining, 6) AS hours_remaining FROM sla2""")
def q_d40(spark, sf):
    x = collab.issue_sla(testmap.issues(spark, sf), AS_OF)
    return finalize(x.select("issue_id", "priority", "status", "sla_hours", "due_date", "is_overdue", "age_hours",
                             "hours_remaining"))


@query("f6_overdue_issues", "WITH " + ISSUES_SQL + "," + SLA_SQL + """
SELECT priority, category, count(*) AS overdue, round(avg(age_hours), 6) AS avg_age_hours
FROM sla2 WHERE is_overdue GROUP BY priority, category""")
def q_f6(spark, sf):
    x = collab.issue_sla(testmap.issues(spark, sf), AS_OF).filter("is_overdue")
    return finalize(x.groupBy("priority", "category").agg(F.count(F.lit(1)).alias("overdue"),
                                                          F.avg("age_hours").alias("avg_age_hours")))


_CYCLE = testmap.STATUS_CYCLE
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, bs in config.STATUS_TRANSITIONS.items() for b in bs)
LOG_SQL = f"""
slog AS (
  SELECT l_orderkey AS issue_id, l_linenumber AS seq, l_shipdate AS ts,
    [{', '.join(repr(s) for s in _CYCLE)}][CAST((l_linenumber + CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END)
      % {len(_CYCLE)} + 1 AS INTEGER)] AS status
  FROM lineitem)"""


@query("d40_status_transitions", "WITH " + LOG_SQL + f""",
allowed AS (SELECT * FROM (VALUES {_ALLOWED}) t(prev_status, status)),
x AS (SELECT *, lag(status) OVER (PARTITION BY issue_id ORDER BY seq, ts, status) AS prev_status FROM slog)
SELECT x.issue_id, CAST(x.seq AS BIGINT) AS seq, x.ts, x.prev_status, x.status,
  CASE WHEN x.prev_status IS NULL THEN true ELSE EXISTS (SELECT 1 FROM allowed a WHERE a.prev_status = x.prev_status
    AND a.status = x.status) END AS valid_transition
FROM x""")
def q_d40t(spark, sf):
    return finalize(collab.transition_check(testmap.status_log(spark, sf)))


@query("t10_current_issue_state", "WITH " + LOG_SQL + """
SELECT issue_id, arg_max(status, (ts, seq, status)) AS current_status, count(*) AS changes, min(ts) AS first_change,
  max(ts) AS last_change
FROM slog GROUP BY issue_id""")
def q_t10(spark, sf):
    return finalize(collab.current_state(testmap.status_log(spark, sf)))


_RULES = " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, {lv} AS level, '{t}' AS trigger_type, {h} AS trigger_hours, "
    f"[{', '.join(repr(x) for x in p)}]::VARCHAR[] AS priorities, [{', '.join(repr(x) for x in c)}]::VARCHAR[] AS categories"
    for r, lv, t, h, p, c in config.ESCALATION_RULES)
ESC_SQL = f"""
rules AS ({_RULES}),
esc AS (
  SELECT i.issue_id, r.rule_id, r.level, r.trigger_type, lower(i.priority) AS priority, lower(i.category) AS category,
    lower(i.status) AS status, (epoch_us({_NOW}) - epoch_us(i.created_at)) / 3600000000.0 AS age_hours
  FROM issues i JOIN rules r ON r.level > 0
   AND (len(r.priorities) = 0 OR list_contains(r.priorities, lower(i.priority)))
   AND (len(r.categories) = 0 OR list_contains(r.categories, lower(i.category)))
   AND lower(i.status) IN ('open', 'in_progress', 'reopened')
   AND (r.trigger_type <> 'time_based' OR (epoch_us({_NOW}) - epoch_us(i.created_at)) / 3600000000.0 >= r.trigger_hours))"""


@query("j13_escalations", "WITH " + ISSUES_SQL + "," + ESC_SQL + """
SELECT issue_id, rule_id, CAST(level AS BIGINT) AS level, trigger_type, priority, category, status,
  round(age_hours, 6) AS age_hours FROM esc""")
def q_j13(spark, sf):
    return finalize(collab.escalation_candidates(testmap.issues(spark, sf), AS_OF))


@query("a27_escalation_stats", "WITH " + ISSUES_SQL + "," + ESC_SQL + """
SELECT CAST(level AS BIGINT) AS level, trigger_type, count(*) AS escalations, count(DISTINCT issue_id) AS issues,
  round(avg(age_hours), 6) AS avg_age_hours FROM esc GROUP BY ALL""")
def q_a27(spark, sf):
    return finalize(collab.escalation_stats(collab.escalation_candidates(testmap.issues(spark, sf), AS_OF)))


_F2 = dict(statuses=["open", "in_progress"], priorities=["critical", "high"], text="issue 1", offset=10, limit=25)


@query("f2_issue_search_page", "WITH " + ISSUES_SQL + """
SELECT * FROM issues WHERE status IN ('open', 'in_progress') AND priority IN ('critical', 'high')
  AND contains(lower(title), 'issue 1')
ORDER BY created_at DESC, issue_id ASC LIMIT 25 OFFSET 10""")
def q_f2(spark, sf):
    page, _ = collab.search(testmap.issues(spark, sf), **_F2)
    return finalize(page)


@query("f2_issue_search_total", "WITH " + ISSUES_SQL + """
SELECT count(*) AS total FROM issues WHERE status IN ('open', 'in_progress') AND priority IN ('critical', 'high')
  AND contains(lower(title), 'issue 1')""")
def q_f2t(spark, sf):
    _, total = collab.search(testmap.issues(spark, sf), **_F2)
    return finalize(total)


@query("a26_issue_distributions", "WITH " + ISSUES_SQL + """,
d AS (SELECT 'status' AS dimension, status AS value FROM issues UNION ALL SELECT 'priority', priority FROM issues
      UNION ALL SELECT 'category', category FROM issues),
c AS (SELECT dimension, value, count(*) AS count FROM d GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value ASC) AS rank FROM c)
WHERE rank <= 10""")
def q_a26(spark, sf):
    return finalize(collab.distributions(testmap.issues(spark, sf)))


# ------------------------------------------------------------------ alerts
_EVCAT = _case("event_type", testmap.EVENT_CATEGORY, "system")
ALERTS_SQL = f"""
alerts_src AS (
  SELECT event_id AS alert_id, ts AS created_at, user_id AS recipient_id,
    CASE WHEN event_type = 'error' AND k < 10 THEN 'safety' ELSE {_EVCAT} END AS category,
    CASE WHEN k % 20 = 0 THEN 'URGENT: item ' || CAST(k AS VARCHAR) WHEN k % 20 = 1 THEN 'Overdue item ' || CAST(k AS VARCHAR)
         ELSE 'Update on item ' || CAST(k AS VARCHAR) END AS title,
    'value ' || CAST(value AS VARCHAR) AS message, event_type || ':' || CAST(k % 10 AS VARCHAR) AS dedup_key, k, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
alerts AS (
  SELECT *, CASE WHEN regexp_matches(lower(concat_ws(' ', title, message)), '{'|'.join(config.URGENT_KEYWORDS)}') THEN 'urgent'
    WHEN regexp_matches(lower(concat_ws(' ', title, message)), '{'|'.join(config.HIGH_KEYWORDS)}') THEN 'high'
    ELSE coalesce({_case('category', config.CATEGORY_PRIORITY, 'normal').replace("ELSE 'normal' END", "END")}, 'normal') END AS priority
  FROM alerts_src)"""
_QH = f"(strftime(created_at, '%H:%M') >= '{config.QUIET_HOURS[0]}' OR strftime(created_at, '%H:%M') <= '{config.QUIET_HOURS[1]}')"


def _alerts(spark, sf):
    a = testmap.alerts(spark, sf)
    return a.withColumn("priority", AL.classify_priority(F.col("title"), F.col("message"), F.col("category")))


@query("p30_t3_t5_alert_routing", "WITH " + ALERTS_SQL + f"""
SELECT alert_id, category, priority, {_QH} AS in_quiet_hours,
  {_case('priority', config.CHANNEL_BY_PRIORITY, 'in_app')} AS channel FROM alerts""")
def q_p30(spark, sf):
    a = _alerts(spark, sf)
    return finalize(a.select("alert_id", "category", "priority", AL.in_quiet_hours(F.col("created_at")).alias("in_quiet_hours"),
                             AL.route_channel(F.col("priority")).alias("channel")))


@query("t1_alert_dedup", "WITH " + ALERTS_SQL + """,
a AS (SELECT alert_id AS id, dedup_key AS k, created_at AS t FROM alerts),
nx AS (SELECT a.id, (SELECT b.id FROM a b WHERE b.k = a.k AND b.t > a.t + INTERVAL 60 MINUTE ORDER BY b.t, b.id LIMIT 1) AS nxt FROM a),
heads AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY k ORDER BY t, id) AS rn FROM a) WHERE rn = 1),
chain AS (WITH RECURSIVE c(id) AS (SELECT id FROM heads UNION ALL
  SELECT nx.nxt FROM c JOIN nx ON nx.id = c.id WHERE nx.nxt IS NOT NULL) SELECT id FROM c)
SELECT alert_id, dedup_key, alert_id IN (SELECT id FROM chain) AS kept FROM alerts""")
def q_t1(spark, sf):
    return finalize(AL.dedup_kept(_alerts(spark, sf)).select("alert_id", "dedup_key", "kept"))


#: What a recipient was sent, alert after alert; `held` is whether this one was not.
FATIGUE_SQL = "WITH RECURSIVE " + ALERTS_SQL + f""",
fa AS (SELECT alert_id, recipient_id, created_at AS t, coalesce(priority = 'urgent' OR category = 'safety', false) AS exempt, priority,
  row_number() OVER (PARTITION BY recipient_id ORDER BY created_at, alert_id) AS n FROM alerts),
fs AS (SELECT alert_id, recipient_id, n, false AS held, [t] AS sent FROM fa WHERE n = 1
  UNION ALL SELECT alert_id, recipient_id, n, held, CASE WHEN held THEN sent ELSE list_append(sent, t) END FROM (
    SELECT fa.alert_id, fa.recipient_id, fa.n, fa.t, fs.sent,
      NOT fa.exempt AND (len(list_filter(fs.sent, lambda x: x >= fa.t - INTERVAL 1 HOUR)) >= {config.MAX_ALERTS_PER_HOUR}
        OR len(list_filter(fs.sent, lambda x: x >= fa.t - INTERVAL 1 DAY)) >= {config.MAX_ALERTS_PER_DAY}) AS held
    FROM fs JOIN fa ON fa.recipient_id IS NOT DISTINCT FROM fs.recipient_id AND fa.n = fs.n + 1))"""


@query("t2_alert_fatigue", FATIGUE_SQL + """
SELECT fs.alert_id, fs.recipient_id, priority, held AS suppressed, CASE WHEN held THEN 'fatigue_limit' END AS suppression_reason FROM fs JOIN fa USING (alert_id)""")
def q_t2(spark, sf):
    out = AL.fatigue_filter(_alerts(spark, sf))
    return finalize(out.select("alert_id", "recipient_id", "priority", "suppressed", "suppression_reason"))


@query("t4_daily_digest", "WITH " + ALERTS_SQL + """
SELECT recipient_id, time_bucket(INTERVAL 1 DAY, created_at) AS day, count(*) AS alerts,
  array_to_string(list_sort(list(alert_id)), ',') AS alert_ids
FROM alerts WHERE priority IN ('low', 'normal') GROUP BY ALL""")
def q_t4(spark, sf):
    d = AL.daily_digest(_alerts(spark, sf))
    return finalize(d.select("recipient_id", F.col("day").cast("timestamp_ntz").alias("day"), "alerts",
                             F.array_join(F.col("alert_ids").cast("array<string>"), ",").alias("alert_ids")))


@query("t6_hourly_alert_counts", "WITH " + ALERTS_SQL + """
SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start,
  time_bucket(INTERVAL 1 HOUR, created_at) + INTERVAL 1 HOUR AS window_end, category, count(*) AS alerts
FROM alerts GROUP BY ALL""")
def q_t6(spark, sf):
    c = AL.windowed_counts(_alerts(spark, sf))
    return finalize(c.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                             F.col("window_end").cast("timestamp_ntz").alias("window_end"), "category", "alerts"))


@query("a28_alert_statistics", "WITH " + ALERTS_SQL + f""",
st AS (SELECT *, CASE WHEN {_QH} AND priority <> 'urgent' THEN 'suppressed' ELSE 'pending' END AS status FROM alerts),
d AS (SELECT 'priority' AS dimension, priority AS value, created_at FROM st UNION ALL
      SELECT 'category', category, created_at FROM st UNION ALL SELECT 'status', status, created_at FROM st)
SELECT dimension, value, count(*) AS alerts,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 1 HOUR) AS last_hour,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 1 DAY) AS last_day
FROM d GROUP BY ALL""")
def q_a28(spark, sf):
    a = _alerts(spark, sf)
    a = a.withColumn("status", F.when(AL.in_quiet_hours(F.col("created_at")) & (F.col("priority") != "urgent"),
                                      "suppressed").otherwise("pending"))
    return finalize(AL.alert_statistics(a, AS_OF_EV))


@query("f5_unread_inbox", "WITH " + ALERTS_SQL + """
SELECT recipient_id, count(*) AS unread, count(*) FILTER (WHERE priority IN ('urgent', 'high')) AS unread_high,
  max(created_at) AS latest
FROM alerts WHERE NOT (category = 'report' AND k % 3 = 0) GROUP BY recipient_id""")
def q_f5(spark, sf):
    a = _alerts(spark, sf)
    # read_at is set for a third of the report alerts; the inbox shows the rest
    unread = a.filter(~((F.col("category") == "report") & (F.col("k") % 3 == 0)))
    return finalize(unread.groupBy("recipient_id").agg(
        F.count(F.lit(1)).alias("unread"), F.count(F.when(F.col("priority").isin("urgent", "high"), 1)).alias("unread_high"),
        F.max("created_at").alias("latest")))


@query("t7_escalation_timeline", "WITH " + ISSUES_SQL + f""",
rules AS ({_RULES}),
x AS (
  SELECT i.issue_id, r.rule_id, r.level, r.trigger_type,
    CAST(ceil((epoch_us(i.created_at) + CAST(CASE WHEN r.trigger_type = 'time_based' THEN r.trigger_hours ELSE 0 END AS BIGINT)
      * 3600000000) / 86400000000.0) AS BIGINT) AS check_no
  FROM issues i JOIN rules r ON (len(r.priorities) = 0 OR list_contains(r.priorities, lower(i.priority)))
   AND (len(r.categories) = 0 OR list_contains(r.categories, lower(i.category)))
   AND lower(i.status) IN ('open', 'in_progress', 'reopened')),
y AS (SELECT *, coalesce(max(level) OVER (PARTITION BY issue_id ORDER BY check_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS before FROM x WHERE check_no * 86400000000 <= epoch_us({_NOW}))
SELECT check_no, CAST(level AS BIGINT) AS level, count(*) FILTER (WHERE level > before) AS fired, count(*) AS eligible
FROM y GROUP BY ALL""")
def q_t7(spark, sf):
    t = collab.escalation_timeline(testmap.issues(spark, sf), AS_OF)
    return finalize(t.groupBy("check_no", "level").agg(F.count(F.when(F.col("fired"), 1)).alias("fired"),
                                                        F.count(F.lit(1)).alias("eligible")))


_EXP = "CASE level " + " ".join(f"WHEN {k} THEN {v}" for k, v in config.APPROVAL_EXPIRY_HOURS_BY_LEVEL.items()) + " END"


@query("t8_approval_expiry", "WITH " + ISSUES_SQL + "," + LOG_SQL + f""",
rules AS ({_RULES}),
x AS (
  SELECT i.issue_id, r.rule_id, r.level,
    CAST(ceil((epoch_us(i.created_at) + CAST(CASE WHEN r.trigger_type = 'time_based' THEN r.trigger_hours ELSE 0 END AS BIGINT)
      * 3600000000) / 86400000000.0) AS BIGINT) AS check_no
  FROM issues i JOIN rules r ON (len(r.priorities) = 0 OR list_contains(r.priorities, lower(i.priority)))
   AND (len(r.categories) = 0 OR list_contains(r.categories, lower(i.category)))
   AND lower(i.status) IN ('open', 'in_progress', 'reopened')),
y AS (SELECT *, coalesce(max(level) OVER (PARTITION BY issue_id ORDER BY check_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS before FROM x WHERE check_no * 86400000000 <= epoch_us({_NOW})),
a AS (SELECT issue_id, rule_id, level, check_no * 86400000000 AS req_us, check_no * 86400000000 + ({_EXP}) * 3600000000 AS exp_us
  FROM y WHERE level > before),
f AS (SELECT a.issue_id, a.rule_id, min(epoch_us(s.ts)) AS first_change_us FROM a LEFT JOIN slog s
  ON s.issue_id = a.issue_id AND epoch_us(s.ts) > a.req_us GROUP BY a.issue_id, a.rule_id)
SELECT a.issue_id, a.rule_id, CAST(a.level AS BIGINT) AS level, a.req_us, a.exp_us,
  CASE WHEN f.first_change_us IS NOT NULL AND f.first_change_us <= a.exp_us THEN 'approved'
       WHEN epoch_us({_NOW}) > a.exp_us THEN 'expired' ELSE 'pending' END AS approval_status
FROM a JOIN f USING (issue_id, rule_id)""")
def q_t8(spark, sf):
    fired = collab.escalation_timeline(testmap.issues(spark, sf), AS_OF)
    return finalize(collab.approval_status(fired, testmap.status_log(spark, sf), AS_OF))
