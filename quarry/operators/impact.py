"""Issue impact and ROI (D34, O12) and the critical-path schedule."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry.session import ensure_checkpoint_dir


def impact_roi(counts: DataFrame) -> DataFrame:
    """Per (entity, issue type) with `issue_count`: direct score =
    count x weight; each downstream type unblocks floor(count x 0.3) at its
    weight; totals, patients unblocked (issues // 2), DQI gain (score x
    0.1), lock days saved (score / 100), effort (count x 0.5 h), ROI."""
    w = F.create_map(*[x for k, v in config.IMPACT_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    deps = F.create_map(*[x for k, v in config.RESOLVER_DEPENDENCIES.items()
                          for x in (F.lit(k), F.array(*[F.lit(d) for d in v]).cast("array<string>"))])
    c = F.col
    cnt = c("issue_count")
    unblocked = F.floor(cnt * config.UNBLOCK_SHARE).cast("long")
    down = F.coalesce(deps[c("issue_type")], F.array().cast("array<string>"))
    x = counts.select("*", (cnt * F.coalesce(w[c("issue_type")], F.lit(1.0))).alias("direct_score"),
                      (unblocked * F.size(down)).alias("downstream_issues"),
                      F.aggregate(down, F.lit(0.0), lambda acc, d: acc + unblocked * F.coalesce(w[d], F.lit(1.0)))
                      .alias("cascade_score"))
    total_issues = cnt + c("downstream_issues")
    score = c("direct_score") + c("cascade_score")
    effort = cnt * 0.5
    return x.select("*", total_issues.alias("total_issues_resolved"), score.alias("total_score"),
                    F.floor(total_issues / 2).cast("long").alias("patients_unblocked"), (score * 0.1).alias("dqi_improvement"),
                    (score / 100).alias("db_lock_days_saved"), effort.alias("effort_hours"),
                    (score / F.greatest(effort, F.lit(0.1))).alias("roi"))


def schedule(spark: SparkSession, durations: DataFrame, dependencies: dict | None = None) -> DataFrame:
    """Earliest / latest start and finish, slack and the critical flag
    for every node of the resolver DAG with `duration` days per node
    (forward and backward longest-path relaxation, one join per round, until
    nothing changes; more rounds than nodes mean a cycle)."""
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([(s, d) for s, ds in (dependencies or config.RESOLVER_DEPENDENCIES).items() for d in ds],
                                  "src string, dst string")
    nodes = durations.select("node", F.col("duration").cast("double").alias("dur"))
    es = nodes.select("node", F.lit(0.0).alias("es"))
    rounds = nodes.count() + 1
    for _ in range(rounds):
        cand = es.join(nodes, "node").join(edges, F.col("node") == F.col("src")) \
            .groupBy(F.col("dst").alias("node")).agg(F.max(F.col("es") + F.col("dur")).alias("c"))
        new = es.join(cand, "node", "left").select("node", F.greatest("es", F.coalesce("c", F.lit(0.0))).alias("es")) \
            .checkpoint(eager=True)
        changed = new.join(es.withColumnRenamed("es", "old"), "node").filter(F.col("es") != F.col("old")).limit(1).count()
        es = new
        if not changed:
            break
    else:
        raise ValueError("the dependencies have a cycle")
    x = es.join(nodes, "node").withColumn("ef", F.col("es") + F.col("dur"))
    end = x.agg(F.max("ef").alias("end")).first()["end"]
    lf = nodes.select("node", F.lit(end).alias("lf"))
    for _ in range(rounds):
        ls = lf.join(nodes, "node").select("node", (F.col("lf") - F.col("dur")).alias("ls"))
        cand = ls.join(edges, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node")).agg(F.min("ls").alias("c"))
        new = lf.join(cand, "node", "left").select("node", F.least("lf", F.coalesce("c", F.lit(end))).alias("lf")) \
            .checkpoint(eager=True)
        changed = new.join(lf.withColumnRenamed("lf", "old"), "node").filter(F.col("lf") != F.col("old")).limit(1).count()
        lf = new
        if not changed:
            break
    else:
        raise ValueError("the dependencies have a cycle")
    out = x.join(lf, "node").withColumn("ls", F.col("lf") - F.col("dur"))
    return out.select("node", F.col("dur").alias("duration"), F.col("es").alias("earliest_start"),
                      F.col("ef").alias("earliest_finish"), F.col("ls").alias("latest_start"), F.col("lf").alias("latest_finish"),
                      (F.col("ls") - F.col("es")).alias("slack"), ((F.col("ls") - F.col("es")) == 0).alias("critical"))


def node_impact(counts: DataFrame) -> DataFrame:
    """D35 per (study, issue type) with `count` (patients with the issue;
    db_lock = ready patients): downstream closure on the explorer DAG (J18),
    patients unblocked = own count + floor(0.3 x count) of each reachable
    node, DQI gain, effort (6 min per issue), days saved (2 per chain node +
    count / 500), ROI and priority."""
    from quarry.functions.exprs import round_half_even
    from quarry.operators import graph
    spark = counts.sparkSession
    edges = spark.createDataFrame([(s, d) for s, ds in config.EXPLORER_DEPENDENCIES.items() for d in ds],
                                  "src string, dst string")
    sources = spark.createDataFrame([(s,) for s in config.EXPLORER_DEPENDENCIES], "node string")
    reach = graph.reachable(edges, sources)
    cnt = counts.select("study_id", F.col("issue_type").alias("node"), F.col("count"))
    # nodes without a count in a study add 0, so an inner join on the node is enough
    down = reach.join(cnt, "node").groupBy("study_id", "source").agg(
        F.sum(F.floor(F.col("count") * 0.3)).cast("long").alias("downstream"))
    chain = reach.groupBy("source").agg(F.count(F.lit(1)).alias("chain_length"))
    w = F.create_map(*[x for k, v in config.EXPLORER_WEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))])
    src = cnt.filter(F.col("node") != "db_lock").withColumnRenamed("node", "source")
    x = src.join(down, ["study_id", "source"], "left").join(F.broadcast(chain), "source", "left") \
        .fillna(0, ["chain_length", "downstream"])
    s = F.col("count").cast("double")
    unblocked = F.col("count") + F.col("downstream")
    dqi = s / 1000 * (F.coalesce(w[F.col("source")], F.lit(50.0)) / 100) * 5
    effort = s * 0.1
    days = F.col("chain_length") * 2 + s / 500
    roi = (unblocked * 10 + dqi * 100) / F.greatest(effort, F.lit(1.0))
    prio = F.when((roi >= 50) | F.col("source").contains("sae"), "Critical").when(roi >= 30, "High") \
        .when(roi >= 15, "Medium").otherwise("Low")
    return x.select("study_id", F.col("source").alias("issue_type"), "count", "chain_length", unblocked.alias("patients_unblocked"),
                    round_half_even(dqi, 2).alias("dqi_improvement"), round_half_even(days, 1).alias("days_saved"),
                    round_half_even(effort, 1).alias("effort_hours"), round_half_even(roi, 1).alias("roi_score"),
                    prio.alias("priority"))
