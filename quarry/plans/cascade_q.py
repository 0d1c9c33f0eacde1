"""Cascade and graph queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import cascade, graph
from quarry.plans import sqlbase as S
from quarry.plans.cache import materialized_plan, shared_plan
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH, enhanced_record

NODES = config.CASCADE_NODES
ALL_NODES = [(n, name, role, w) for n, _, name, role, w in NODES] + [config.LOCK_NODE]
EDGES = [(s, d) for s, ds in config.ISSUE_DEPENDENCIES.items() for d in ds]


def _f(x):
    return repr(float(x))


@shared_plan
def node_table(spark, sf):
    return cascade.node_table(spark).checkpoint(eager=True)


@materialized_plan
def cascade_record(spark, sf):
    return cascade.cascade_impact(enhanced_record(spark, sf), node_table(spark, sf))


# ------------------------------------------------------------------ SQL side
_NAME_CASE = " ".join(f"WHEN '{n}' THEN '{name}'" for n, name, _, _ in ALL_NODES)
_NODES_V = ", ".join(f"('{n}', '{name}', {_f(w)})" for n, name, _, w in ALL_NODES)
_EDGES_V = ", ".join(f"('{s}', '{d}')" for s, d in EDGES)


def pagerank_sql(max_iter: int = config.PAGERANK_MAX_ITER, boost: str | None = None) -> str:
    n = len(ALL_NODES)
    a = config.PAGERANK_ALPHA
    parts = [f"g_nodes AS (SELECT * FROM (VALUES {_NODES_V}) t(node, name, weight))",
             f"g_edges AS (SELECT * FROM (VALUES {_EDGES_V}) t(src, dst))",
             "g_rev AS (SELECT dst AS src, src AS dst FROM g_edges)",
             "g_ep AS (SELECT e.src, e.dst, 1.0 / o.o AS p FROM g_rev e JOIN (SELECT src, count(*) AS o FROM g_rev GROUP BY src) o USING (src))",
             "g_dang AS (SELECT node AS src FROM g_nodes WHERE node NOT IN (SELECT src FROM g_rev))",
             f"pr0 AS MATERIALIZED (SELECT node, {_f(1.0 / n)} AS pr FROM g_nodes)"]
    for i in range(1, max_iter + 1):
        parts.append(
            f"pr{i} AS MATERIALIZED (SELECT g.node, {_f(a)} * coalesce(c.c, 0.0) + {_f(a)} * coalesce(d.d, 0.0) / {n} "
            f"+ {_f((1 - a) / n)} AS pr FROM g_nodes g LEFT JOIN (SELECT ep.dst AS node, sum(r.pr * ep.p) AS c "
            f"FROM g_ep ep JOIN pr{i - 1} r ON ep.src = r.node GROUP BY ep.dst) c USING (node) CROSS JOIN "
            f"(SELECT sum(r.pr) AS d FROM g_dang JOIN pr{i - 1} r ON g_dang.src = r.node) d)")
    errs = " UNION ALL ".join(
        f"SELECT {i} AS it, sum(abs(a.pr - b.pr)) AS err FROM pr{i} a JOIN pr{i - 1} b USING (node)"
        for i in range(1, max_iter + 1))
    parts.append(f"g_err AS ({errs})")
    parts.append(f"g_stop AS (SELECT coalesce(min(it) FILTER (WHERE err < {n} * {_f(config.PAGERANK_TOL)}), {max_iter}) AS it FROM g_err)")
    allpr = " UNION ALL ".join(f"SELECT {i} AS it, node, pr FROM pr{i}" for i in range(1, max_iter + 1))
    parts.append(f"g_pr AS (SELECT node, pr FROM ({allpr}) x WHERE it = (SELECT it FROM g_stop))")
    if boost:
        parts.append(f"g_s AS (SELECT g.node, p.pr * g.weight * (1.0 + log10(coalesce(b.count, 0) + 1.0) / 5.0) AS s "
                     f"FROM g_pr p JOIN g_nodes g USING (node) LEFT JOIN {boost} b USING (node))")
        parts.append("g_unlock AS (SELECT node, least(round_even(s / (SELECT max(s) FROM g_s) * 100.0, 2), 100.0) "
                     "AS unlock_score FROM g_s)")
    else:
        parts.append("g_s AS (SELECT g.node, p.pr * g.weight AS s FROM g_pr p JOIN g_nodes g USING (node))")
        parts.append("g_unlock AS (SELECT node, round_even(s / (SELECT max(s) FROM g_s) * 100.0, 2) AS unlock_score FROM g_s)")
    parts.append("""g_paths AS (
  WITH RECURSIVE p(path) AS (SELECT ['db_lock'] UNION ALL
    SELECT list_prepend(e.src, p.path) FROM p JOIN g_edges e ON e.dst = p.path[1] WHERE NOT list_contains(p.path, e.src))
  SELECT path[1] AS node, path, len(path) AS length FROM p WHERE len(path) > 1)""")
    parts.append(f"""g_short AS (
  SELECT node, length, path_text FROM (
    SELECT node, length, array_to_string(list_transform(path, lambda x: CASE x {_NAME_CASE} END), ' → ') AS path_text,
      row_number() OVER (PARTITION BY node ORDER BY length, path) AS rn FROM g_paths) WHERE rn = 1)""")
    parts.append("g_table AS (SELECT u.node, u.unlock_score, s.length, s.path_text FROM g_unlock u LEFT JOIN g_short s USING (node))")
    return ",\n".join(parts)


_SORTED = sorted(NODES, key=lambda t: t[0])


def _cascade_sql() -> str:
    sc = "(SELECT unlock_score FROM g_table WHERE node = '{n}')"
    pl = "(SELECT length FROM g_table WHERE node = '{n}')"
    pt = "(SELECT path_text FROM g_table WHERE node = '{n}')"
    nxt = cascade.NEXT_UNLOCK
    items = ", ".join(
        f"CASE WHEN coalesce({c}, 0) > 0 THEN {{'k': -{sc.format(n=n)}, 'o': {i}, 'type': '{n}', 'name': '{name}', "
        f"'count': CAST({c} AS BIGINT), 'score': {sc.format(n=n)}, 'next': {repr(nxt[n]) if nxt[n] else 'NULL'}, "
        f"'plen': {pl.format(n=n)}, 'ptxt': {pt.format(n=n)}}} END"
        for i, (n, c, name, _, _) in enumerate(NODES))
    bits = " || ".join(f"CASE WHEN coalesce({c}, 0) > 0 THEN '1' ELSE '0' END" for _, c, *_ in _SORTED)
    names = ", ".join(f"CASE WHEN coalesce({c}, 0) > 0 THEN '{name}' END" for _, c, name, *_ in _SORTED)
    return f"""
cx_a AS (SELECT *, list_sort(list_filter([{items}], lambda x: x IS NOT NULL)) AS iss,
  list_filter([{names}], lambda x: x IS NOT NULL) AS nm, {bits} AS cascade_issue_pattern FROM elock),
cx_b AS (SELECT *, len(iss) AS n_iss,
  list_sort(iss, 'DESC')[1] AS _unused,
  (SELECT x FROM (SELECT unnest(iss) AS x) ORDER BY x.score DESC, x.o ASC LIMIT 1) AS best,
  (SELECT x FROM (SELECT unnest(iss) AS x) ORDER BY x.plen DESC, x.o ASC LIMIT 1) AS longest
  FROM cx_a),
cascade AS (
  SELECT *,
    round_even(coalesce(list_sum(list_transform(iss, lambda x: x.score * ln(1 + CAST(x.count AS DOUBLE)))), 0.0), 2)
      AS cascade_impact_score,
    best.type AS cascade_primary_blocker,
    CASE WHEN n_iss = 0 THEN 'Clean - No cascade'
         WHEN n_iss = 1 THEN 'Fix ' || iss[1].name || ' (' || CAST(iss[1].count AS VARCHAR) || ') → DB Lock Ready'
         ELSE array_to_string(list_transform(list_slice(iss, 1, 3), lambda x, i: 'Fix ' || x.name || ' (' || CAST(x.count AS VARCHAR) || ')'
              || CASE WHEN i < n_iss AND x.next IS NOT NULL THEN ' → Unlocks ' || x.next ELSE '' END), ' → ') || ' → DB Lock' END
      AS cascade_recommendation,
    CAST(n_iss AS BIGINT) AS cascade_issue_count,
    CASE WHEN n_iss = 0 THEN 'Ready' WHEN longest.ptxt IS NULL THEN 'Direct to DB Lock' ELSE longest.ptxt END AS cascade_critical_path,
    CAST(CASE WHEN n_iss = 0 THEN 0 ELSE coalesce(longest.plen, 0) END AS BIGINT) AS cascade_path_length,
    CASE WHEN len(nm) = 0 THEN 'Clean' WHEN len(nm) = 1 THEN 'Only: ' || nm[1]
         WHEN len(nm) <= 3 THEN 'Combo: ' || array_to_string(nm, ' + ') ELSE 'Complex: ' || CAST(len(nm) AS VARCHAR) || ' issues' END
      AS cascade_cluster
  FROM cx_b)"""


CASCADE_SQL = ENH + ", " + pagerank_sql() + ", " + _cascade_sql()
_D19 = ["patient_key", "cascade_impact_score", "cascade_primary_blocker", "cascade_recommendation", "cascade_issue_count",
        "cascade_critical_path", "cascade_path_length", "cascade_issue_pattern", "cascade_cluster"]


@query("d19_d21_cascade_impact", CASCADE_SQL + "\nSELECT " + ", ".join(
    S.r6(c, c) if c == "cascade_impact_score" else c for c in _D19) + " FROM cascade")
def q_d19(spark, sf):
    return finalize(cascade_record(spark, sf).select(*_D19))


@query("a16_site_cascade", CASCADE_SQL + """
, sc AS (
  SELECT study_id, site_id, count(*) AS patient_count, sum(cascade_impact_score) AS total_cascade_impact,
    avg(cascade_impact_score) AS avg_cascade_impact, CAST(sum(cascade_issue_count) AS BIGINT) AS total_issues,
    max(cascade_path_length) AS max_path_length
  FROM cascade GROUP BY study_id, site_id),
tb0 AS (SELECT study_id, site_id, cascade_primary_blocker AS b, count(*) AS c FROM cascade
  WHERE cascade_primary_blocker IS NOT NULL GROUP BY study_id, site_id, cascade_primary_blocker),
tb AS (SELECT study_id, site_id, b AS top_blocker FROM (
  SELECT *, row_number() OVER (PARTITION BY study_id, site_id ORDER BY c DESC, b ASC) AS rn FROM tb0) WHERE rn = 1)
SELECT sc.study_id, sc.site_id, patient_count, round(total_cascade_impact, 6) AS total_cascade_impact,
  round(avg_cascade_impact, 6) AS avg_cascade_impact, total_issues, max_path_length, top_blocker,
  round(round_even(total_issues / patient_count, 2), 6) AS cascade_density,
  round(CASE WHEN (SELECT max(total_cascade_impact) FROM sc) > 0
    THEN round_even(total_cascade_impact / (SELECT max(total_cascade_impact) FROM sc) * 100.0, 1) ELSE 0.0 END, 6) AS cascade_priority
FROM sc LEFT JOIN tb USING (study_id, site_id)""")
def q_a16(spark, sf):
    return finalize(cascade.site_cascade(cascade_record(spark, sf)))


_ROLE = " ".join(f"WHEN '{name}' THEN '{role}'" for _, _, name, role, _ in NODES)


@query("d22_cascade_narratives", CASCADE_SQL + f"""
SELECT patient_key, study_id, site_id, round(cascade_impact_score, 6) AS cascade_score, iss[1].name AS primary_issue,
  iss[1].count AS primary_count, CASE iss[1].name {_ROLE} END AS primary_role, cascade_issue_count AS total_issues,
  'Fix ' || iss[1].name || ' (' || CAST(iss[1].count AS VARCHAR) || ' items) at ' || site_id AS narrative,
  'Unlocks ' || CAST(cascade_issue_count - 1 AS VARCHAR) || ' downstream issues → Path to DB Lock' AS impact,
  CASE WHEN cascade_issue_count > 1 THEN array_to_string(list_transform(list_slice(iss, 1, 4),
    lambda x: x.name || ' (' || CAST(x.count AS VARCHAR) || ')'), ' → ') || ' → DB Lock'
    ELSE iss[1].name || ' → DB Lock' END AS action_chain
FROM cascade WHERE coalesce(dblock_eligible, true) AND NOT coalesce(dblock_tier1_ready, false) AND cascade_issue_count > 0
ORDER BY cascade_impact_score DESC, patient_key ASC LIMIT {config.CASCADE_TOP_N}""")
def q_d22(spark, sf):
    return finalize(cascade.narratives(cascade_record(spark, sf)))


_COUNTS_SQL = "g_counts AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS node, count(*) FILTER (WHERE {c} > 0) AS count FROM elock" for n, c, *_ in NODES) + ")"


@query("g4_weighted_edges", ENH + ", " + _COUNTS_SQL + f""",
g_edges AS (SELECT * FROM (VALUES {_EDGES_V}) t(src, dst))
SELECT src, dst, coalesce(a.count, 0) AS src_count, coalesce(b.count, 0) AS dst_count,
  least(coalesce(a.count, 0), coalesce(b.count, 0)) AS weight
FROM g_edges LEFT JOIN g_counts a ON a.node = src LEFT JOIN g_counts b ON b.node = dst""")
def q_g4(spark, sf):
    _, edges = graph.dependency_graph(spark)
    return finalize(graph.weighted_edges(edges, cascade.node_counts(enhanced_record(spark, sf))))


@query("g5_boosted_unlock_scores", ENH + ", " + _COUNTS_SQL + ", " + pagerank_sql(boost="g_counts") +
       "\nSELECT node, round(unlock_score, 6) AS unlock_score FROM g_unlock")
def q_g5(spark, sf):
    nodes, edges = graph.dependency_graph(spark)
    counts = cascade.node_counts(enhanced_record(spark, sf))
    return finalize(graph.unlock_scores(nodes, edges, boost=counts))


@query("g3_downstream_reach", ENH + ", " + _COUNTS_SQL + f""",
g_edges AS (SELECT * FROM (VALUES {_EDGES_V}) t(src, dst)),
r AS (WITH RECURSIVE r(source, node) AS (
    SELECT c.node, e.dst FROM g_counts c JOIN g_edges e ON e.src = c.node WHERE c.count > 0
    UNION SELECT r.source, e.dst FROM r JOIN g_edges e ON e.src = r.node)
  SELECT DISTINCT source, node FROM r)
SELECT source, node FROM r""")
def q_g3(spark, sf):
    _, edges = graph.dependency_graph(spark)
    present = cascade.node_counts(enhanced_record(spark, sf)).filter(F.col("count") > 0).select("node")
    return finalize(graph.reachable(edges, present))


@query("g7_heaviest_path", ENH + ", " + _COUNTS_SQL + f""",
g_edges AS (SELECT * FROM (VALUES {_EDGES_V}) t(src, dst)),
p AS (WITH RECURSIVE p(path) AS (SELECT ['db_lock'] UNION ALL
    SELECT list_prepend(e.src, p.path) FROM p JOIN g_edges e ON e.dst = p.path[1] WHERE NOT list_contains(p.path, e.src))
  SELECT path FROM p WHERE len(path) > 1),
pw AS (SELECT path, path[1] AS start, unnest(path) AS node FROM p),
agg AS (SELECT start, path, CAST(sum(coalesce(c.count, 0)) AS BIGINT) AS weight,
    arg_max(pw.node, struct_pack(c2 := coalesce(c.count, 0), n := pw.node)) AS bottleneck
  FROM pw LEFT JOIN g_counts c USING (node) WHERE pw.node <> 'db_lock' GROUP BY start, path)
SELECT start, array_to_string(path, '>') AS path, weight, bottleneck FROM (
  SELECT *, row_number() OVER (PARTITION BY start ORDER BY weight DESC, path ASC) AS rn FROM agg) WHERE rn = 1""")
def q_g7(spark, sf):
    _, edges = graph.dependency_graph(spark)
    counts = cascade.node_counts(enhanced_record(spark, sf))
    best = graph.heaviest_paths_to(edges, counts, config.LOCK_NODE[0])
    top = best.select("start", "path", "weight", F.explode("path").alias("node")).filter(F.col("node") != config.LOCK_NODE[0]) \
        .join(counts, "node", "left").groupBy("start", "path", "weight") \
        .agg(F.max(F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.col("node")))["node"].alias("bottleneck"))
    return finalize(top.select("start", F.array_join("path", ">").alias("path"), "weight", "bottleneck"))
