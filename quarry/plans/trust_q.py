"""Trust metric queries."""
from __future__ import annotations

from quarry import config
from quarry.operators import trust as TR
from quarry.plans.registry import finalize, query
from quarry.sources import testmap

_OUT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in testmap.EVENT_OUTCOME.items())
INTER_SQL = f"""
x AS (SELECT event_id, ts AS timestamp, user_id, 'agent_' || CAST(user_id % 5 AS VARCHAR) AS agent_name,
  CASE event_type {_OUT} END AS outcome, value AS time_to_decision_seconds,
  CASE WHEN event_type = 'signup' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1 END AS rating,
  CASE WHEN event_type = 'signup' THEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS INTEGER) END AS would_recommend
FROM events)"""
_D = config.TRUST_PERIOD_DAYS
_END = "TIMESTAMP '2024-02-01 00:00:00'"


def _pm(lo, hi, pre):
    p = f"timestamp >= {_END} - INTERVAL {lo} DAY AND timestamp < {_END} - INTERVAL {hi} DAY"
    return f"""SELECT count(*) FILTER (WHERE {p} AND outcome IS NOT NULL) AS {pre}total,
  count(*) FILTER (WHERE {p} AND outcome = 'overridden') AS {pre}overrides, count(*) FILTER (WHERE {p} AND outcome = 'accepted') AS {pre}accepted,
  count(*) FILTER (WHERE {p} AND outcome = 'accepted_modified') AS {pre}modified, count(*) FILTER (WHERE {p} AND outcome = 'rejected') AS {pre}rejected,
  count(*) FILTER (WHERE {p} AND outcome = 'auto_executed') AS {pre}auto,
  avg(time_to_decision_seconds) FILTER (WHERE {p} AND outcome IS NOT NULL) AS {pre}avg_dec,
  count(*) FILTER (WHERE {p} AND rating IS NOT NULL) AS {pre}sat_n, avg(rating) FILTER (WHERE {p}) AS {pre}rating,
  count(*) FILTER (WHERE {p} AND would_recommend = 1) AS {pre}prom, count(*) FILTER (WHERE {p} AND would_recommend = 0) AS {pre}detr,
  count(DISTINCT user_id) FILTER (WHERE {p}) AS {pre}active FROM x"""


_W = config.TRUST_WEIGHTS
_LVL = " ".join(f"WHEN s >= {t} THEN '{lab}'" for t, lab in config.TRUST_LEVELS)


@query("a36_trust_metrics", "WITH " + INTER_SQL + f""",
c AS ({_pm(_D, 0, '')}), p AS ({_pm(2 * _D, _D, 'p_')}), u AS (SELECT count(DISTINCT user_id) AS total_users FROM x),
m AS (SELECT *, CASE WHEN total > 0 THEN overrides / total ELSE 0.0 END AS orate,
  CASE WHEN total > 0 THEN (accepted + modified + auto) / total ELSE 0.0 END AS arate,
  CASE WHEN total > 0 THEN modified / total ELSE 0.0 END AS mrate, coalesce(rating, 0.0) AS r,
  CASE WHEN prom + detr > 0 THEN (prom - detr) * 100.0 / (prom + detr) ELSE 0.0 END AS nps,
  CASE WHEN total_users > 0 THEN active / total_users ELSE 0.0 END AS adopt,
  CASE WHEN p_total > 0 THEN p_overrides / p_total ELSE 0.0 END AS p_orate, coalesce(p_rating, 0.0) AS p_r FROM c, p, u),
s AS (SELECT *, greatest(0.0, least(100.0, arate * 100 * {_W['acceptance']!r} + (CASE WHEN r > 0 THEN r / 5 * 100 ELSE 50.0 END) * {_W['satisfaction']!r}
  + adopt * 100 * {_W['adoption']!r} + (100.0 - orate * 50) * {_W['override']!r})) AS s FROM m)
SELECT total AS total_interactions, overrides, round(orate, 6) AS override_rate, accepted, modified AS accepted_modified, rejected,
  round(arate, 6) AS acceptance_rate, round(mrate, 6) AS modification_rate, round(avg_dec, 6) AS avg_decision_seconds,
  sat_n AS satisfaction_count, round(round_even(r, 2), 6) AS avg_satisfaction, round(round_even(nps, 1), 6) AS nps_score,
  prom AS promoters, detr AS detractors, active AS active_users, total_users, round(adopt, 6) AS adoption_rate,
  CASE WHEN p_orate = 0 THEN 'stable' WHEN (orate - p_orate) / p_orate < -{config.TREND_CHANGE} THEN 'improving'
       WHEN (orate - p_orate) / p_orate > {config.TREND_CHANGE} THEN 'declining' ELSE 'stable' END AS override_rate_trend,
  CASE WHEN p_r = 0 THEN 'stable' WHEN (r - p_r) / p_r > {config.TREND_CHANGE} THEN 'improving'
       WHEN (r - p_r) / p_r < -{config.TREND_CHANGE} THEN 'declining' ELSE 'stable' END AS satisfaction_trend,
  round(round_even(s, 1), 6) AS trust_score, CASE {_LVL} ELSE '{config.TRUST_LEVEL_FLOOR}' END AS trust_level
FROM s""")
def q_a36(spark, sf):
    return finalize(TR.trust_metrics(testmap.interactions(spark, sf), config.AS_OF_EVENTS))


@query("a31_acceptance_by_agent", "WITH " + INTER_SQL + f"""
SELECT agent_name, count(*) AS total, count(*) FILTER (WHERE outcome IN ('accepted', 'accepted_modified', 'auto_executed')) AS accepted,
  count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome = 'overridden') AS overridden,
  round(count(*) FILTER (WHERE outcome IN ('accepted', 'accepted_modified', 'auto_executed')) / count(*), 6) AS acceptance_rate
FROM x WHERE timestamp >= {_END} - INTERVAL {_D} DAY AND timestamp < {_END} AND outcome IS NOT NULL GROUP BY agent_name""")
def q_a31(spark, sf):
    return finalize(TR.acceptance_by_agent(testmap.interactions(spark, sf), config.AS_OF_EVENTS))
