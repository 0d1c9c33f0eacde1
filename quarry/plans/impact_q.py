"""Impact / ROI and schedule queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import impact as IM
from quarry.operators import issues as IS
from quarry.plans import sqlbase as S
from quarry.plans.cache import materialized_plan
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query


def _site_counts(spark, sf):
    rows = IS.issue_rows(issue_record(spark, sf))
    return rows.groupBy("site_id", "issue_type").agg(F.sum("issue_count").alias("issue_count"))


@materialized_plan
def impact_table(spark, sf):
    return IM.impact_roi(_site_counts(spark, sf))


_ROWS = " UNION ALL ".join(f"SELECT site_id, '{t}' AS issue_type, CAST(count_{t} AS DOUBLE) AS c FROM iss WHERE issue_{t} = 1"
                           for t in IS.TYPES)
_W = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in config.IMPACT_WEIGHTS.items()) + " ELSE 1.0 END"
_DW = lambda d: repr(config.IMPACT_WEIGHTS.get(d, 1.0))
_NDOWN = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in config.RESOLVER_DEPENDENCIES.items()) + " ELSE 0 END"
_DSUM = "CASE issue_type " + " ".join(
    f"WHEN '{k}' THEN {' + '.join(_DW(d) for d in v) if v else '0.0'}" for k, v in config.RESOLVER_DEPENDENCIES.items()) + " ELSE 0.0 END"
IMPACT_SQL = S.with_record(ISSUES) + f""",
ir AS ({_ROWS}),
sc AS (SELECT site_id, issue_type, sum(c) AS issue_count FROM ir GROUP BY ALL),
im0 AS (SELECT *, issue_count * {_W} AS direct_score, CAST(floor(issue_count * {config.UNBLOCK_SHARE}) AS BIGINT) AS ub FROM sc),
im AS (SELECT site_id, issue_type, issue_count, direct_score, ub * ({_NDOWN}) AS downstream_issues,
  0.0 + ub * ({_DSUM}) AS cascade_score FROM im0),
imp AS (SELECT *, issue_count + downstream_issues AS total_issues_resolved, direct_score + cascade_score AS total_score,
  CAST(floor((issue_count + downstream_issues) / 2) AS BIGINT) AS patients_unblocked, (direct_score + cascade_score) * 0.1 AS dqi_improvement,
  (direct_score + cascade_score) / 100 AS db_lock_days_saved, issue_count * 0.5 AS effort_hours,
  (direct_score + cascade_score) / greatest(issue_count * 0.5, 0.1) AS roi FROM im)"""
_COLS = ["site_id", "issue_type", "issue_count", "direct_score", "downstream_issues", "cascade_score", "total_issues_resolved",
         "total_score", "patients_unblocked", "dqi_improvement", "db_lock_days_saved", "effort_hours", "roi"]
_INT = {"site_id", "issue_type", "downstream_issues", "patients_unblocked"}
_SEL = ", ".join(c if c in _INT else S.r6(c, c) for c in _COLS)


@query("d34_impact_roi", IMPACT_SQL + f" SELECT {_SEL} FROM imp")
def q_d34(spark, sf):
    return finalize(impact_table(spark, sf).select(*_COLS))


@query("o12_top_roi", IMPACT_SQL + f" SELECT {_SEL} FROM imp ORDER BY roi DESC, site_id, issue_type LIMIT 10")
def q_o12(spark, sf):
    t = impact_table(spark, sf).select(*_COLS)
    return finalize(t.orderBy(F.col("roi").desc(), "site_id", "issue_type").limit(10))


_RATE = "CASE node " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in config.ISSUE_RESOLUTION_RATES.items()) + \
    f" ELSE {float(config.DEFAULT_RESOLUTION_RATE)!r} END"
_TOT = " UNION ALL ".join(f"SELECT '{t}' AS node, coalesce(sum(count_{t}), 0) AS total FROM iss" for t in IS.TYPES)
_EDGES = ", ".join(f"('{s}', '{d}')" for s, ds in config.RESOLVER_DEPENDENCIES.items() for d in ds)


def _durations(spark, sf):
    i = issue_record(spark, sf)
    one = i.agg(*[F.coalesce(F.sum(f"count_{t}"), F.lit(0.0)).alias(t) for t in IS.TYPES])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("node"), F.col(t).alias("total")) for t in IS.TYPES])).alias("r"))
    rate = F.create_map(*[x for k, v in config.ISSUE_RESOLUTION_RATES.items() for x in (F.lit(k), F.lit(float(v)))])
    return rows.select("r.node", F.ceil(F.col("r.total") / F.coalesce(rate[F.col("r.node")],
                                                                        F.lit(float(config.DEFAULT_RESOLUTION_RATE))))
                       .cast("double").alias("duration"))


@query("g6_issue_schedule", S.with_record(ISSUES) + f""",
dur AS (SELECT node, CAST(ceil(total / {_RATE}) AS DOUBLE) AS d FROM ({_TOT})),
e AS (SELECT * FROM (VALUES {_EDGES}) t(src, dst)),
esr AS (WITH RECURSIVE p(node, es) AS (SELECT node, CAST(0.0 AS DOUBLE) FROM dur UNION ALL
  SELECT e.dst, p.es + dur.d FROM p JOIN e ON e.src = p.node JOIN dur ON dur.node = p.node) SELECT node, max(es) AS es FROM p GROUP BY node),
x AS (SELECT dur.node, dur.d, esr.es, esr.es + dur.d AS ef FROM dur JOIN esr USING (node)),
lfr AS (WITH RECURSIVE q(node, lf) AS (SELECT node, (SELECT max(ef) FROM x) FROM dur UNION ALL
  SELECT e.src, q.lf - dur.d FROM q JOIN e ON e.dst = q.node JOIN dur ON dur.node = q.node) SELECT node, min(lf) AS lf FROM q GROUP BY node)
SELECT node, round(d, 6) AS duration, round(es, 6) AS earliest_start, round(ef, 6) AS earliest_finish, round(lf - d, 6) AS latest_start,
  round(lf, 6) AS latest_finish, round(lf - d - es, 6) AS slack, lf - d - es = 0 AS critical
FROM x JOIN lfr USING (node)""")
def q_g6(spark, sf):
    return finalize(IM.schedule(spark, _durations(spark, sf)))


from quarry.plans.scores_q import ENH, enhanced_record  # noqa: E402


def _study_counts(spark, sf):
    i = issue_record(spark, sf)
    one = i.groupBy("study_id").agg(*[F.sum(f"issue_{t}").alias(t) for t in IS.TYPES])
    rows = one.select("study_id", F.explode(F.array(*[F.struct(F.lit(t).alias("issue_type"), F.col(t).cast("long").alias("count"))
                                                      for t in IS.TYPES])).alias("r")).select("study_id", "r.*")
    ready = enhanced_record(spark, sf).groupBy("study_id").agg(F.count(F.when(F.col("dblock_tier1_ready"), 1)).alias("count")) \
        .select("study_id", F.lit("db_lock").alias("issue_type"), "count")
    return rows.unionByName(ready)


_XE = ", ".join(f"('{s}', '{d}')" for s, ds in config.EXPLORER_DEPENDENCIES.items() for d in ds)
_XW = "CASE source " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in config.EXPLORER_WEIGHTS.items()) + " ELSE 50.0 END"
_CNT = " UNION ALL ".join(f"SELECT study_id, '{t}' AS node, CAST(sum(issue_{t}) AS BIGINT) AS count FROM iss GROUP BY study_id"
                          for t in IS.TYPES)


@query("d35_node_impact", ENH + "," + ISSUES + f""",
e AS (SELECT * FROM (VALUES {_XE}) t(src, dst)),
r AS (WITH RECURSIVE r(source, node) AS (SELECT src, dst FROM e UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.node)
  SELECT DISTINCT source, node FROM r),
c AS ({_CNT} UNION ALL SELECT study_id, 'db_lock', count(*) FILTER (WHERE dblock_tier1_ready) FROM elock GROUP BY study_id),
d AS (SELECT s.study_id, r.source, count(*) AS chain_length, CAST(sum(floor(coalesce(c.count, 0) * 0.3)) AS BIGINT) AS downstream
  FROM r CROSS JOIN (SELECT DISTINCT study_id FROM c) s LEFT JOIN c ON c.study_id = s.study_id AND c.node = r.node GROUP BY ALL),
x AS (SELECT c.study_id, c.node AS source, c.count, coalesce(d.chain_length, 0) AS chain_length, coalesce(d.downstream, 0) AS downstream
  FROM c LEFT JOIN d ON d.study_id = c.study_id AND d.source = c.node WHERE c.node <> 'db_lock'),
y AS (SELECT *, count + downstream AS pu, CAST(count AS DOUBLE) / 1000 * ({_XW} / 100) * 5 AS dqi, CAST(count AS DOUBLE) * 0.1 AS effort,
  chain_length * 2 + CAST(count AS DOUBLE) / 500 AS days FROM x),
z AS (SELECT *, (pu * 10 + dqi * 100) / greatest(effort, 1.0) AS roi FROM y)
SELECT study_id, source AS issue_type, count, chain_length, pu AS patients_unblocked, round(round_even(dqi, 2), 6) AS dqi_improvement,
  round(round_even(days, 1), 6) AS days_saved, round(round_even(effort, 1), 6) AS effort_hours, round(round_even(roi, 1), 6) AS roi_score,
  CASE WHEN roi >= 50 OR contains(source, 'sae') THEN 'Critical' WHEN roi >= 30 THEN 'High' WHEN roi >= 15 THEN 'Medium' ELSE 'Low' END
    AS priority
FROM z""")
def q_d35(spark, sf):
    return finalize(IM.node_impact(_study_counts(spark, sf)))
