"""Report queries (A39, A46, A50, A55, A61, A65, A68, A69, D39, M3, M10,
M11, X8)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import collab, patterns as PT, reports as RP, textops as TX, trust as TR
from quarry.operators.issues import TYPES
from quarry.plans import sqlbase as S
from quarry.plans.cascade_q import CASCADE_SQL, cascade_record
from quarry.plans.collab_q import ISSUES_SQL, LOG_SQL
from quarry.plans.core import rec
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.ml_q import FEATURES
from quarry.plans.patterns_q import MATCH_SQL, site_patterns
from quarry.plans.registry import finalize, query
from quarry.plans.resolution_q import RECS_SQL, recs
from quarry.plans.scores_q import ENH, enhanced_record
from quarry.plans.trust_q import INTER_SQL
from quarry.sources import testmap
from quarry.sources.tables import load


@query("a50_entity_column_summary", S.with_record() + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(CAST(sum({c}) AS DOUBLE), 6) AS total FROM record "
    f"WHERE study_id = 'Study_1'" for c in FEATURES))
def q_a50(spark, sf):
    return finalize(RP.entity_column_summary(rec(spark, sf), "study_id", "Study_1", FEATURES))


@query("a55_site_quality_matrix", CASCADE_SQL + "," + ISSUES + """,
a AS (SELECT study_id, site_id, count(*) AS patients, avg(dqi_score) AS dqi_mean, count(*) FILTER (WHERE dblock_tier1_ready) AS ready
  FROM elock GROUP BY ALL),
b AS (SELECT study_id, site_id, CAST(sum(total_issues) AS BIGINT) AS issues, sum(count_open_queries) AS open_queries FROM iss GROUP BY ALL),
c AS (SELECT study_id, site_id, avg(cascade_impact_score) AS cascade_mean FROM cascade GROUP BY ALL)
SELECT study_id, site_id, patients, round(dqi_mean, 6) AS dqi_mean, ready, issues, round(open_queries, 6) AS open_queries,
  round(cascade_mean, 6) AS cascade_mean,
  CASE WHEN dqi_mean >= 95 THEN 'Pristine' WHEN dqi_mean >= 85 THEN 'Excellent' WHEN dqi_mean >= 75 THEN 'Good'
       ELSE 'Needs Attention' END AS quality_tier
FROM a JOIN b USING (study_id, site_id) JOIN c USING (study_id, site_id)""")
def q_a55(spark, sf):
    return finalize(RP.site_quality_matrix(enhanced_record(spark, sf), issue_record(spark, sf), cascade_record(spark, sf)))


_SITES = ["Site_1", "Site_2", "Site_3", "Site_5", "Site_8"]
_IN = ", ".join(f"'{s}'" for s in _SITES)


@query("a68_role_portfolio", ENH + "," + ISSUES + f"""
SELECT * FROM (SELECT count(*) AS patients, count(DISTINCT site_id) AS sites, round(avg(dqi_score), 6) AS dqi_mean,
  count(*) FILTER (WHERE tier2_clean) AS clean, count(*) FILTER (WHERE dblock_tier1_ready) AS ready FROM elock WHERE site_id IN ({_IN})),
 (SELECT CAST(sum(total_issues) AS BIGINT) AS issues, count(*) FILTER (WHERE priority_tier = 'critical') AS critical
  FROM iss WHERE site_id IN ({_IN}))""")
def q_a68(spark, sf):
    return finalize(RP.role_portfolio(enhanced_record(spark, sf), issue_record(spark, sf), _SITES))


@query("a69_path_to_lock", ENH + f"""
, s AS (SELECT study_id, count(*) FILTER (WHERE dblock_tier1_ready) AS current_ready,
  avg(CAST(dblock_tier1_ready AS DOUBLE)) * 100 AS current_ready_pct FROM elock WHERE dblock_eligible GROUP BY study_id)
SELECT study_id, current_ready, round(current_ready_pct, 6) AS current_ready_pct,
  round({config.LOCK_TARGET_READY_PCT} - current_ready_pct, 6) AS gap_pct,
  CAST(CASE WHEN {config.LOCK_TARGET_READY_PCT} - current_ready_pct > 0
       THEN greatest(1, CAST(floor(({config.LOCK_TARGET_READY_PCT} - current_ready_pct) / {config.LOCK_DAILY_IMPROVEMENT}) AS INTEGER))
       ELSE 0 END AS BIGINT) AS days_to_target
FROM s""")
def q_a69(spark, sf):
    return finalize(RP.path_to_lock(enhanced_record(spark, sf)))


_BI = config.BLOCKER_INFO
_D = config.BLOCKER_DEFAULT
_RESP = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _BI.items()) + f" ELSE '{_D[0]}' END"
_IMP = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in _BI.items()) + f" ELSE {_D[1]} END"
_EFF = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {v[2]!r}" for k, v in _BI.items()) + f" ELSE {_D[2]!r} END"
_ROWS = " UNION ALL ".join(f"SELECT study_id, {i} AS o, '{t}' AS issue_type, CAST(sum(issue_{t}) AS BIGINT) AS count FROM iss GROUP BY study_id"
                           for i, t in enumerate(TYPES))


@query("a69_lock_blockers", S.with_record(ISSUES) + f""",
r AS (SELECT * FROM ({_ROWS}) WHERE count > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY count DESC, o ASC) AS rank FROM r)
SELECT study_id, CAST(rank AS BIGINT) AS rank,
  array_to_string(list_transform(string_split(replace(issue_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS issue_type,
  count, CAST(least(count, floor(count * 0.8)) AS BIGINT) AS patients_affected, {_RESP} AS responsible, CAST({_IMP} AS BIGINT) AS impact,
  round(count * CAST({_EFF} AS DOUBLE), 6) AS effort_hours, CAST(greatest(1, floor(count * CAST({_EFF} AS DOUBLE) / 8)) AS BIGINT) AS days_to_resolve
FROM k WHERE rank <= 5""")
def q_a69b(spark, sf):
    return finalize(RP.lock_blockers(issue_record(spark, sf)))


_SLA = "CASE issue_type " + " ".join(f"WHEN '{t[0]}' THEN {t[5]}" for t in config.ISSUE_TYPES) + " END"


@query("d39_work_items", RECS_SQL + f"""
SELECT site_id, issue_type, min(recommended_action) AS task, min(responsible_role) AS owner, count(DISTINCT patient_key) AS patients,
  round(sum(CAST(estimated_effort_hours AS DOUBLE)), 6) AS effort_hours, min(issue_rank) AS best_rank,
  CASE WHEN min(issue_rank) = 1 THEN 'high' ELSE 'normal' END AS priority,
  CAST(DATE '2001-12-31' + CAST({_SLA} AS INTEGER) AS DATE) AS due_date
FROM recs GROUP BY site_id, issue_type""")
def q_d39(spark, sf):
    return finalize(RP.work_items(recs(spark, sf), config.AS_OF_STAR))


_T = config.UPDATE_TRIGGERS


@query("a39_update_triggers", "WITH " + INTER_SQL + f""",
p AS (SELECT count(*) AS pending FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL),
c AS (SELECT count(*) FILTER (WHERE outcome IS NOT NULL) AS total, count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
  count(*) FILTER (WHERE outcome = 'overridden') AS overrides FROM x
  WHERE timestamp >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL {config.TRUST_PERIOD_DAYS} DAY AND timestamp < TIMESTAMP '2024-02-01 00:00:00'),
s AS (SELECT count(*) AS cal FROM x WHERE outcome = 'rejected' AND time_to_decision_seconds < 30 AND 0.6 > {_T['calibration_signal_size']})
SELECT 'rejection_rate' AS trigger FROM c WHERE CASE WHEN total > 0 THEN rejected / total ELSE 0.0 END > {_T['rejection_rate']}
UNION ALL SELECT 'override_rate' FROM c WHERE CASE WHEN total > 0 THEN overrides / total ELSE 0.0 END > {_T['override_rate']}
UNION ALL SELECT 'pending_feedback' FROM p WHERE pending >= {_T['pending_feedback']}
UNION ALL SELECT 'calibration_signals' FROM s WHERE cal >= {_T['calibration_signals']}""")
def q_a39(spark, sf):
    x = testmap.interactions(spark, sf)
    trust = TR.trust_metrics(x, config.AS_OF_EVENTS)
    pending = testmap.predictions(spark, sf).agg(F.count(F.when(F.col("outcome_type").isNull(), 1)).alias("pending"))
    return finalize(RP.update_triggers(trust, TR.learning_signals(x), pending))


_RUNS_SQL = """
runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_orderpriority AS run_type, o_totalprice / 100 AS duration_s, o_orderdate AS started_at FROM orders)"""


@query("a46_run_statistics", "WITH " + _RUNS_SQL + """
SELECT status, run_type, count(*) AS runs, round(avg(duration_s), 6) AS mean_duration_s,
  round((SELECT avg(CAST(status = 'success' AS DOUBLE)) FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 100)), 6)
    AS recent_success_rate
FROM runs GROUP BY status, run_type""")
def q_a46(spark, sf):
    o = load(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"])
    runs = o.select(F.col("o_orderkey").alias("run_id"),
                    F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running")
                    .otherwise("failed").alias("status"), F.col("o_orderpriority").alias("run_type"),
                    (F.col("o_totalprice") / 100).alias("duration_s"), F.col("o_orderdate").alias("started_at"))
    return finalize(RP.run_statistics(runs))


@query("a61_pattern_group_features", MATCH_SQL + """
SELECT m.study_id, m.pattern_id, count(*) AS sites, round(avg(s.patient_count), 6) AS patient_count_mean,
  round(avg(s.ipp), 6) AS issues_per_patient_mean, round(stddev_samp(s.patient_count), 6) AS patient_count_std,
  round(stddev_samp(s.ipp), 6) AS issues_per_patient_std
FROM matches m JOIN s ON s.study_id = m.study_id AND s.site_id = m.entity_id GROUP BY m.study_id, m.pattern_id""")
def q_a61(spark, sf):
    site = PT.site_base(issue_record(spark, sf)).select("study_id", "site_id", "patient_count", "issues_per_patient")
    return finalize(RP.group_features(site_patterns(spark, sf), site, ["patient_count", "issues_per_patient"]))


@query("a65_tag_statistics", f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TX.MENTION_PATTERN}', 1)) AS value, 'mention' AS tag_type FROM documents),
h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TX.HASHTAG_PATTERN}', 1)) AS value, 'topic' AS tag_type FROM documents)
SELECT tag_type, count(*) AS occurrences, count(DISTINCT value) AS distinct_tags, count(DISTINCT doc_id) AS documents
FROM (SELECT * FROM m UNION ALL SELECT * FROM h) GROUP BY tag_type""")
def q_a65(spark, sf):
    return finalize(RP.tag_statistics(TX.extract_tags(load(spark, sf, "documents", ["doc_id", "text"]), "doc_id")))


def _impute_input(spark, sf):
    sp = testmap.spine(spark, sf).select("subject_key", "patient_key")
    oc = testmap.order_counters(spark, sf).select("subject_key", "visit_visits_overdue_avg_days", "visit_visits_overdue_max_days")
    x = sp.join(oc, "subject_key", "left")
    band = F.when(F.col("visit_visits_overdue_max_days") > 2000, "very_old") \
        .when(F.col("visit_visits_overdue_max_days") > 1000, "old").when(F.col("visit_visits_overdue_max_days").isNotNull(), "recent")
    return x.withColumn("visit_band", band)


@query("m3_imputation", S.with_record() + """
, x AS (SELECT s.patient_key, o.visit_visits_overdue_avg_days AS a, o.visit_visits_overdue_max_days AS m,
  CASE WHEN o.visit_visits_overdue_max_days > 2000 THEN 'very_old' WHEN o.visit_visits_overdue_max_days > 1000 THEN 'old'
       WHEN o.visit_visits_overdue_max_days IS NOT NULL THEN 'recent' END AS band
  FROM spine s LEFT JOIN order_agg o USING (subject_key)),
md AS (SELECT band AS mode_band FROM x WHERE band IS NOT NULL GROUP BY band ORDER BY count(*) DESC, band ASC LIMIT 1)
SELECT patient_key, round(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM x)), 6) AS visit_visits_overdue_avg_days,
  round(coalesce(m, (SELECT quantile_cont(m, 0.5) FROM x)), 6) AS visit_visits_overdue_max_days,
  coalesce(band, (SELECT mode_band FROM md)) AS visit_band FROM x""")
def q_m3(spark, sf):
    x = _impute_input(spark, sf)
    return finalize(RP.impute(x, ["patient_key"], ["visit_visits_overdue_avg_days", "visit_visits_overdue_max_days"], ["visit_band"]))


_RES_SQL = "WITH " + ISSUES_SQL + "," + LOG_SQL + """,
st AS (SELECT issue_id, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS DOUBLE) AS resolution_days FROM slog GROUP BY 1),
d AS (SELECT i.issue_id, i.priority, st.resolution_days FROM issues i JOIN st USING (issue_id)),
q AS (SELECT priority, count(*) AS n, quantile_cont(resolution_days, 0.1) AS p10, quantile_cont(resolution_days, 0.5) AS p50,
  quantile_cont(resolution_days, 0.9) AS p90 FROM d WHERE issue_id % 5 <> 0 GROUP BY priority)"""


def _resolution(spark, sf):
    cs = collab.current_state(testmap.status_log(spark, sf))
    days = F.datediff(F.to_date("last_change"), F.to_date("first_change")).cast("double")
    i = testmap.issues(spark, sf).select("issue_id", "priority")
    return i.join(cs.select("issue_id", days.alias("resolution_days")), "issue_id")


@query("m10_quantile_baseline", _RES_SQL + """
SELECT priority, n, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM q""")
def q_m10(spark, sf):
    d = _resolution(spark, sf)
    return finalize(RP.quantile_baseline(d.filter(F.col("issue_id") % 5 != 0), ["priority"], "resolution_days"))


@query("m11_interval_metrics", _RES_SQL + """,
t AS (SELECT d.*, q.p10, q.p50, q.p90 FROM d JOIN q USING (priority) WHERE issue_id % 5 = 0)
SELECT coalesce(priority, 'overall') AS priority, count(*) AS n,
  round(avg(CAST(resolution_days >= p10 AND resolution_days <= p90 AS DOUBLE)), 6) AS coverage,
  round(avg(abs(resolution_days - p50)), 6) AS mae, round(sqrt(avg((resolution_days - p50) * (resolution_days - p50))), 6) AS rmse,
  round(avg(p90 - p10), 6) AS mean_width
FROM t GROUP BY ROLLUP (priority)""")
def q_m11(spark, sf):
    d = _resolution(spark, sf)
    base = RP.quantile_baseline(d.filter(F.col("issue_id") % 5 != 0), ["priority"], "resolution_days")
    test = d.filter(F.col("issue_id") % 5 == 0).join(base.drop("n"), "priority")
    return finalize(RP.interval_metrics(test, "resolution_days", "priority"))


@query("x8_oversample", S.with_record() + """
, n AS (SELECT risk_level, count(*) AS c FROM record GROUP BY 1),
t AS (SELECT max(c) AS t FROM n),
r AS (SELECT r.patient_key, r.risk_level, unnest(generate_series(0, CAST(ceil(t.t / n.c) AS BIGINT) - 1)) AS replica
  FROM record r JOIN n USING (risk_level), t),
k AS (SELECT *, row_number() OVER (PARTITION BY risk_level ORDER BY md5(patient_key || '|' || CAST(replica AS VARCHAR))) AS rn FROM r)
SELECT patient_key, risk_level, CAST(replica AS BIGINT) AS replica FROM k, t WHERE rn <= t.t""")
def q_x8(spark, sf):
    r = rec(spark, sf).select("patient_key", "risk_level")
    return finalize(RP.oversample(r, "risk_level", "patient_key").select("patient_key", "risk_level", "replica"))


_BN = " UNION ALL ".join(
    f"SELECT {i} AS o, '{t}' AS issue_type, '{n}' AS issue_name, {imp} AS impact_score, count(*) FILTER (WHERE count_{t} > 0) AS patient_count FROM iss"
    for i, (t, n, imp) in enumerate(config.BOTTLENECKS))
_MUL = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in config.DOWNSTREAM_MULTIPLIERS.items()) + " ELSE 1.0 END"


@query("a54_bottlenecks", S.with_record(ISSUES) + f""",
b AS ({_BN})
SELECT issue_type, issue_name, CAST(impact_score AS BIGINT) AS impact_score, patient_count,
  CAST(floor(patient_count * impact_score / 100) AS BIGINT) AS blocking_score,
  CAST(floor(patient_count * {_MUL}) AS BIGINT) AS downstream_blocked
FROM b WHERE patient_count > 0 ORDER BY floor(patient_count * impact_score / 100) DESC, o LIMIT 10""")
def q_a54(spark, sf):
    return finalize(RP.bottlenecks(issue_record(spark, sf)))


_OPEN = " + ".join(f"coalesce(count_{t}, 0.0)" for t in TYPES)


@query("a75_site_progress", ENH + "," + ISSUES + f""",
a AS (SELECT study_id, site_id, count(*) AS total_patients, count(*) FILTER (WHERE tier2_clean) AS clean_patients,
  count(*) FILTER (WHERE dblock_tier1_ready) AS db_lock_ready, avg(dqi_score) AS dqi_score FROM elock GROUP BY ALL),
b AS (SELECT study_id, site_id, sum({_OPEN}) AS open_issues FROM iss GROUP BY ALL)
SELECT study_id, site_id, total_patients, clean_patients, db_lock_ready, round(dqi_score, 6) AS dqi_score,
  round(open_issues, 6) AS open_issues, round(clean_patients / total_patients * 100, 6) AS completion_rate,
  CASE WHEN dqi_score >= 90 THEN 'improving' WHEN dqi_score < 75 THEN 'declining' ELSE 'stable' END AS trend
FROM a LEFT JOIN b USING (study_id, site_id)""")
def q_a75(spark, sf):
    return finalize(RP.site_progress(enhanced_record(spark, sf), issue_record(spark, sf)))
