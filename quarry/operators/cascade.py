"""Cascade impact over the issue dependency graph.

Per-node results of the graph algorithms (unlock score, critical path)
form a table of one row per node; it is folded into a single map row and
broadcast, so per-patient scoring stays a row-wise expression.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import round_half_even

from quarry import config
from quarry.operators import graph

NODES = config.CASCADE_NODES
NAME = {n: name for n, _, name, _, _ in NODES} | {config.LOCK_NODE[0]: config.LOCK_NODE[1]}
NEXT_UNLOCK = {s: next((NAME[d] for d in ds if d != "db_lock"), None) for s, ds in config.ISSUE_DEPENDENCIES.items()}


def node_counts(record: DataFrame) -> DataFrame:
    """Patients with each issue (count > 0), one row per node (data-derived)."""
    one = record.agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(n) for n, c, *_ in NODES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.col(n).alias("count"))
                                          for n, *_ in NODES])).alias("x")).select("x.*")


def node_table(spark, counts: DataFrame | None = None) -> DataFrame:
    """Per node: unlock score (G1, or G5 with counts) and shortest path to
    lock (G2) as display text and length."""
    nodes, edges = graph.dependency_graph(spark)
    scores = graph.unlock_scores(nodes, edges, boost=counts)
    paths = graph.shortest_paths_to(edges, config.LOCK_NODE[0])
    names = nodes.select("node", "name")
    ptxt = paths.select("start", F.posexplode("path").alias("i", "node")).join(names, "node") \
        .groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))),
                                                        lambda s: s["name"]), " → ").alias("path_text"))
    return scores.join(paths.select(F.col("start").alias("node"), "length"), "node", "left") \
        .join(ptxt.withColumnRenamed("start", "node"), "node", "left")


def _node_map(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.map_from_entries(F.collect_list(F.struct(
        "node", F.struct("unlock_score", "length", "path_text")))).alias("_m"))


def cascade_impact(record: DataFrame, nodes: DataFrame) -> DataFrame:
    """D19-D21, P22 for each patient.

    impact = sum(unlock x ln(1 + count)) (2 dp); primary blocker = largest
    unlock score (first declared on ties); recommendation text over the
    three highest-scoring issues; critical path = longest of the shortest
    paths of present issues; bit pattern over sorted node names and its
    cluster name.
    """
    r = record.crossJoin(F.broadcast(_node_map(nodes)))
    m = F.col("_m")
    items = F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.struct(
        (-m[n]["unlock_score"]).alias("k"), F.lit(i).alias("o"), F.lit(n).alias("type"), F.lit(name).alias("name"),
        F.col(c).cast("long").alias("count"), m[n]["unlock_score"].alias("score"),
        F.lit(NEXT_UNLOCK.get(n)).alias("next"), m[n]["length"].alias("plen"), m[n]["path_text"].alias("ptxt")))
        for i, (n, c, name, _, _) in enumerate(NODES)])
    r = r.withColumn("_iss", F.array_sort(F.array_compact(items)))
    iss = F.col("_iss")
    impact = F.aggregate(iss, F.lit(0.0), lambda acc, x: acc + x["score"] * F.log1p(x["count"].cast("double")))
    top3 = F.slice(iss, 1, 3)
    n_iss = F.size(iss)

    def part(x, i):
        plain = F.concat(F.lit("Fix "), x["name"], F.lit(" ("), x["count"].cast("string"), F.lit(")"))
        return F.when((i < n_iss - 1) & x["next"].isNotNull(),
                      F.concat(plain, F.lit(" → Unlocks "), x["next"])).otherwise(plain)

    rec_txt = F.when(n_iss == 0, F.lit("Clean - No cascade")) \
        .when(n_iss == 1, F.concat(F.lit("Fix "), F.get(iss, 0)["name"], F.lit(" ("), F.get(iss, 0)["count"].cast("string"),
                                   F.lit(") → DB Lock Ready"))) \
        .otherwise(F.concat(F.array_join(F.transform(top3, part), " → "), F.lit(" → DB Lock")))
    # primary blocker / critical path: first declared among the maxima
    by_decl = F.array_sort(F.transform(iss, lambda x: F.struct(x["o"].alias("o"), x["type"].alias("type"),
                                                                x["score"].alias("score"), x["plen"].alias("plen"),
                                                                x["ptxt"].alias("ptxt"))))
    best = F.aggregate(by_decl, F.lit(None).cast("struct<o:int,type:string,score:double,plen:int,ptxt:string>"),
                       lambda acc, x: F.when(acc.isNull() | (x["score"] > acc["score"]), x).otherwise(acc))
    longest = F.aggregate(by_decl, F.lit(None).cast("struct<o:int,type:string,score:double,plen:int,ptxt:string>"),
                          lambda acc, x: F.when(acc.isNull() | (x["plen"] > acc["plen"]), x).otherwise(acc))
    sorted_nodes = sorted(NODES, key=lambda t: t[0])
    bits = F.concat(*[F.when(F.coalesce(F.col(c), F.lit(0)) > 0, "1").otherwise("0") for _, c, *_ in sorted_nodes])
    names_sorted = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.lit(name))
                                             for _, c, name, *_ in sorted_nodes]))
    k = F.size(names_sorted)
    cluster = F.when(k == 0, "Clean").when(k == 1, F.concat(F.lit("Only: "), F.get(names_sorted, 0))) \
        .when(k <= 3, F.concat(F.lit("Combo: "), F.array_join(names_sorted, " + "))) \
        .otherwise(F.concat(F.lit("Complex: "), k.cast("string"), F.lit(" issues")))
    path = F.when(n_iss == 0, "Ready").when(longest["ptxt"].isNull(), "Direct to DB Lock").otherwise(longest["ptxt"])
    out = r.select(*record.columns,
                   round_half_even(impact, 2).alias("cascade_impact_score"),
                   best["type"].alias("cascade_primary_blocker"),
                   rec_txt.alias("cascade_recommendation"),
                   n_iss.alias("cascade_issue_count"),
                   path.alias("cascade_critical_path"),
                   F.when(n_iss == 0, 0).otherwise(F.coalesce(longest["plen"], F.lit(0))).alias("cascade_path_length"),
                   bits.alias("cascade_issue_pattern"), cluster.alias("cascade_cluster"),
                   F.transform(F.slice(iss, 1, 4), lambda x: F.concat(x["name"], F.lit(" ("), x["count"].cast("string"),
                                                                      F.lit(")"))).alias("_chain"),
                   F.get(iss, 0)["name"].alias("_p_name"), F.get(iss, 0)["count"].alias("_p_count"))
    return out


def site_cascade(df: DataFrame) -> DataFrame:
    """Per site impact sum / mean, issue total, max path, density, top
    blocker (most frequent; ties -> smallest id) and priority (% of max)."""
    c = F.col
    s = df.groupBy("study_id", "site_id").agg(
        F.count(F.lit(1)).alias("patient_count"), F.sum("cascade_impact_score").alias("total_cascade_impact"),
        F.avg("cascade_impact_score").alias("avg_cascade_impact"), F.sum("cascade_issue_count").alias("total_issues"),
        F.max("cascade_path_length").alias("max_path_length"),
        F.mode("cascade_primary_blocker", deterministic=True).alias("top_blocker"))
    s = s.withColumn("cascade_density", round_half_even(c("total_issues") / c("patient_count"), 2))
    mx = s.agg(F.max("total_cascade_impact").alias("_mx"))
    return s.crossJoin(F.broadcast(mx)).withColumn(
        "cascade_priority", F.when(c("_mx") > 0, round_half_even(c("total_cascade_impact") / c("_mx") * 100.0, 1))
        .otherwise(F.lit(0.0))).drop("_mx")


def narratives(df: DataFrame, role: dict | None = None, top_n: int = config.CASCADE_TOP_N) -> DataFrame:
    """Top-N eligible, not-ready patients by impact (ties by key),
    with fix / impact / chain text.  The limit is the feature (a top-N
    report) and runs as TakeOrderedAndProject: each task keeps N rows."""
    c = F.col
    roles = {name: r for _, _, name, r, _ in NODES}
    role_map = F.create_map(*[x for k, v in roles.items() for x in (F.lit(k), F.lit(v))])
    cand = df.filter(F.coalesce(c("dblock_eligible"), F.lit(True)) & ~F.coalesce(c("dblock_tier1_ready"), F.lit(False))
                     & (c("cascade_issue_count") > 0))
    top = cand.orderBy(c("cascade_impact_score").desc(), c("patient_key").asc()).limit(top_n)
    n = c("cascade_issue_count")
    return top.select(
        "patient_key", "study_id", "site_id", c("cascade_impact_score").alias("cascade_score"),
        c("_p_name").alias("primary_issue"), c("_p_count").alias("primary_count"),
        role_map[c("_p_name")].alias("primary_role"), n.alias("total_issues"),
        F.concat(F.lit("Fix "), c("_p_name"), F.lit(" ("), c("_p_count").cast("string"), F.lit(" items) at "),
                 c("site_id")).alias("narrative"),
        F.concat(F.lit("Unlocks "), (n - 1).cast("string"), F.lit(" downstream issues → Path to DB Lock")).alias("impact"),
        F.when(n > 1, F.concat(F.array_join("_chain", " → "), F.lit(" → DB Lock")))
        .otherwise(F.concat(c("_p_name"), F.lit(" → DB Lock"))).alias("action_chain"))
