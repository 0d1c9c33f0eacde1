"""Streaming queries: each drains the event stream into a parquet sink and
returns a scan of the result; the SQL twin is the batch definition."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.plans.collab_q import ALERTS_SQL, FATIGUE_SQL
from quarry.plans.registry import finalize, query
from quarry.session import ensure_checkpoint_dir
from quarry.streaming import alerts_stream as ST


@query("t6_stream_hourly_counts", "WITH " + ALERTS_SQL + """
SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start,
  time_bucket(INTERVAL 1 HOUR, created_at) + INTERVAL 1 HOUR AS window_end, category, count(*) AS alerts
FROM alerts GROUP BY ALL""")
def q_t6s(spark, sf):
    out = ST.all_hourly_counts(spark, sf)
    return finalize(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                               F.col("window_end").cast("timestamp_ntz").alias("window_end"), "category", "alerts"))


@query("t1_stream_dedup", "WITH " + ALERTS_SQL + """,
a AS (SELECT alert_id AS id, dedup_key AS k, created_at AS t FROM alerts),
nx AS (SELECT a.id, (SELECT b.id FROM a b WHERE b.k = a.k AND b.t > a.t + INTERVAL 60 MINUTE ORDER BY b.t, b.id LIMIT 1) AS nxt FROM a),
heads AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY k ORDER BY t, id) AS rn FROM a) WHERE rn = 1),
chain AS (WITH RECURSIVE c(id) AS (SELECT id FROM heads UNION ALL
  SELECT nx.nxt FROM c JOIN nx ON nx.id = c.id WHERE nx.nxt IS NOT NULL) SELECT id FROM c)
SELECT alert_id, dedup_key, alert_id IN (SELECT id FROM chain) AS kept FROM alerts""")
def q_t1s(spark, sf):
    return finalize(ST.dedup_stream(ST.alert_stream(spark, sf)))


@query("t2_stream_fatigue", FATIGUE_SQL + " SELECT alert_id, recipient_id, held AS suppressed FROM fs")
def q_t2s(spark, sf):
    return finalize(ST.fatigue_stream(ST.alert_stream(spark, sf)))


@query("t11_circuit_states", """
WITH RECURSIVE ce AS (SELECT 'user_' || user_id AS component, ts, event_id, coalesce(event_type = 'error', false) AS bad,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
cs AS (SELECT component, n, ts, event_id, 'closed' AS state, CAST(bad AS INTEGER) AS failures, CAST(NULL AS TIMESTAMP) AS opened FROM ce WHERE n = 1
  UNION ALL SELECT component, n, ts, event_id,
    CASE WHEN half THEN CASE WHEN bad THEN 'open' ELSE 'closed' END WHEN state = 'open' OR (bad AND failures + 1 >= 3) THEN 'open' ELSE 'closed' END,
    CASE WHEN half AND NOT bad THEN 0 WHEN state = 'open' THEN failures WHEN bad THEN failures + 1 ELSE 0 END,
    CASE WHEN (half AND bad) OR (state = 'closed' AND bad AND failures + 1 >= 3) THEN ts ELSE opened END
  FROM (SELECT ce.component, ce.n, ce.ts, ce.event_id, ce.bad, cs.state, cs.failures, cs.opened, cs.state = 'open' AND ce.ts - cs.opened >= INTERVAL 60 MINUTE AS half
    FROM cs JOIN ce ON ce.component IS NOT DISTINCT FROM cs.component AND ce.n = cs.n + 1))
SELECT component, ts, event_id, state FROM cs""")
def q_t11(spark, sf):
    return finalize(ST.circuit_states(ST.event_stream(spark, sf)))


@query("t12_usage_sessions", """
WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, round(sum(value), 6) AS value
FROM s GROUP BY user_id, nth""")
def q_t12(spark, sf):
    s = ST.all_usage_sessions(spark, sf)
    return finalize(s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                             F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events", "value"))


@query("t9_daily_upsert", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL""")
def q_t9(spark, sf):
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/quarry-tables/daily-{uuid.uuid4().hex[:10]}"
    ST.daily_upsert(ST.event_stream(spark, sf), path)
    return finalize(ST.daily_totals(spark, path).select("day", "event_type", "events", "value"))
