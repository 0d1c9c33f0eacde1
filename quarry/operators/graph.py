"""Graph operators over edge DataFrames.

Graphs are (src, dst) edge tables and a node table; every step is a join
plus an aggregate, iterated from the driver with the intermediate result
checkpointed (reliable checkpoint in the shared folder) so lineage stays
one step deep.  Only scalars (a convergence error, an "any new rows"
flag) come back to the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.exprs import round_half_even

from quarry import config
from quarry.session import ensure_checkpoint_dir


def dependency_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The issue dependency DAG as (nodes, edges) frames (fixed values)."""
    nodes = [(n, name, role, w) for n, _, name, role, w in config.CASCADE_NODES] + [config.LOCK_NODE]
    nodes_df = spark.createDataFrame(nodes, "node string, name string, role string, weight double")
    edges = [(s, d) for s, ds in config.ISSUE_DEPENDENCIES.items() for d in ds]
    return nodes_df, spark.createDataFrame(edges, "src string, dst string")


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = config.PAGERANK_ALPHA,
             max_iter: int = config.PAGERANK_MAX_ITER, tol: float = config.PAGERANK_TOL,
             weight: str | None = None) -> DataFrame:
    """G1: PageRank with uniform teleport and dangling mass spread evenly.

    Stops like the usual power iteration: when the L1 change is below
    N * tol, or after `max_iter` steps.  Edge weights default to 1.
    Returns (node, pagerank).
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    n = nodes.count()
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(F.col("src"), F.col("dst"), w.alias("w"))
    e = e.join(e.groupBy("src").agg(F.sum("w").alias("_out")), "src").select(
        "src", "dst", (F.col("w") / F.col("_out")).alias("p"))
    e = e.checkpoint(eager=True)
    dangling = nodes.select(F.col("node").alias("src")).join(e.select("src").distinct(), "src", "left_anti")
    dangling = dangling.checkpoint(eager=True)
    ranks = nodes.select("node", F.lit(1.0 / n).alias("pr")).checkpoint(eager=True)
    for it in range(max_iter):
        contrib = e.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")) \
            .agg(F.sum(F.col("pr") * F.col("p")).alias("c"))
        dsum = dangling.join(ranks.withColumnRenamed("node", "src"), "src").agg(F.sum("pr").alias("d"))
        new = nodes.select("node").join(contrib, "node", "left").crossJoin(dsum).select(
            "node", (F.lit(alpha) * F.coalesce(F.col("c"), F.lit(0.0))
                     + F.lit(alpha) * F.coalesce(F.col("d"), F.lit(0.0)) / n + F.lit((1 - alpha) / n)).alias("pr"))
        new = new.checkpoint(eager=True)
        err = new.join(ranks.withColumnRenamed("pr", "old"), "node").agg(
            F.sum(F.abs(F.col("pr") - F.col("old"))).alias("e")).first()["e"]
        ranks = new
        if err < n * tol:
            break
    pagerank.iterations = it + 1
    return ranks.withColumnRenamed("pr", "pagerank")


def unlock_scores(nodes: DataFrame, edges: DataFrame, boost: DataFrame | None = None) -> DataFrame:
    """Issue importance: PageRank on the reversed DAG x node weight, scaled
    so the maximum is 100 (2 dp).  With `boost` (node, count) the score is
    multiplied by 1 + log10(count + 1) / 5 and capped at 100 (G5)."""
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pr = pagerank(nodes.select("node"), rev)
    s = pr.join(nodes.select("node", "weight"), "node").select("node", (F.col("pagerank") * F.col("weight")).alias("s"))
    if boost is not None:
        s = s.join(boost, "node", "left").select(
            "node", (F.col("s") * (F.lit(1.0) + F.log10(F.coalesce(F.col("count"), F.lit(0)) + 1.0) / 5.0)).alias("s"))
    mx = s.agg(F.max("s").alias("mx"))
    out = s.crossJoin(mx).select("node", "s", round_half_even(F.col("s") / F.col("mx") * 100.0, 2).alias("unlock_score"))
    if boost is not None:
        out = out.withColumn("unlock_score", F.least(F.col("unlock_score"), F.lit(100.0)))
    return out.drop("s")


def shortest_paths_to(edges: DataFrame, target: str) -> DataFrame:
    """Per start node the shortest path to target; ties -> the
    lexicographically smallest node sequence.

    Breadth first from the target: each round reaches the nodes one edge
    further away that no earlier round has reached, and keeps one path for
    each, so the work is that of the edges, whatever number of paths there is.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select("src", "dst").distinct()
    frontier = spark.createDataFrame([(target, [target])], "start string, path array<string>")
    done = frontier
    while True:
        grown = frontier.join(e, F.col("start") == F.col("dst")) \
            .groupBy(F.col("src").alias("start")).agg(F.min(F.concat(F.array("src"), "path")).alias("path")) \
            .join(done.select("start"), "start", "left_anti").checkpoint(eager=True)
        if grown.isEmpty():
            break
        done = done.unionByName(grown).checkpoint(eager=True)
        frontier = grown
    return done.filter(F.col("start") != target).select("start", "path", F.size("path").alias("length"))


def heaviest_paths_to(edges: DataFrame, weights: DataFrame, target: str) -> DataFrame:
    """Per start node of a DAG the path to target with the largest sum of
    `weights` (node, count; the target's own is left out); ties -> the
    smallest node sequence.  Longest-path relaxation: one path per node, rounds
    until nothing changes; more rounds than nodes mean a cycle."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select("src", "dst").distinct().join(weights.select(F.col("node").alias("src"), "count"), "src", "left") \
        .select("src", "dst", F.coalesce("count", F.lit(0)).cast("long").alias("own")).checkpoint(eager=True)
    nodes = e.select("src").union(e.select("dst")).distinct().count()
    best = spark.createDataFrame([(target, 0, [target])], "start string, weight long, path array<string>")
    for _ in range(nodes + 1):
        step = best.join(e, F.col("start") == F.col("dst")).select(
            F.col("src").alias("start"), (F.col("own") + F.col("weight")).alias("weight"), F.concat(F.array("src"), "path").alias("path"))
        both = best.unionByName(step)
        most = both.groupBy("start").agg(F.max("weight").alias("weight"))
        new = both.join(most, ["start", "weight"]).groupBy("start", "weight").agg(F.min("path").alias("path")).checkpoint(eager=True)
        if new.join(best, ["start", "weight", "path"], "left_anti").isEmpty():
            return best.filter(F.col("start") != target)
        best = new
    raise ValueError("the graph has a cycle")


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node) pairs reachable by one or more edges;
    iterative join until no new pair appears."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("src", "dst")
    reach = sources.select(F.col("node").alias("source")).join(e, F.col("source") == F.col("src")) \
        .select("source", F.col("dst").alias("node")).distinct().checkpoint(eager=True)
    frontier = reach
    while True:
        nxt = frontier.join(e, frontier.node == e.src).select("source", F.col("dst").alias("node")).distinct()
        nxt = nxt.join(reach, ["source", "node"], "left_anti").checkpoint(eager=True)
        if nxt.isEmpty():
            return reach
        reach = reach.unionByName(nxt).checkpoint(eager=True)
        frontier = nxt


def weighted_edges(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Edge weight = min(source count, target count)."""
    c = counts.select("node", "count")
    return edges.join(c.withColumnRenamed("node", "src").withColumnRenamed("count", "src_count"), "src", "left") \
        .join(c.withColumnRenamed("node", "dst").withColumnRenamed("count", "dst_count"), "dst", "left") \
        .select("src", "dst", F.coalesce("src_count", F.lit(0)).alias("src_count"),
                F.coalesce("dst_count", F.lit(0)).alias("dst_count"),
                F.least(F.coalesce("src_count", F.lit(0)), F.coalesce("dst_count", F.lit(0))).alias("weight"))
