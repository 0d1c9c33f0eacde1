"""More report operators (A39, A46, A50, A55, A61, A65, A68, A69, D39, M3,
M10, M11, X8)."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.issues import META, TYPES
from quarry.functions.quantiles import exact_quantiles, group_quantiles
from quarry.operators.ml import ordered_row_number


def entity_column_summary(df: DataFrame, entity_col: str, entity: str, cols: Sequence[str]) -> DataFrame:
    """Mean and sum of every numeric column for one entity, one pass."""
    x = df.filter(F.col(entity_col) == entity)
    one = x.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.sum(c).cast("double").alias(f"{c}__s") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__m").alias("mean"), F.col(f"{c}__s").alias("total"))
                     for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def site_quality_matrix(scores: DataFrame, issues: DataFrame, cascade: DataFrame) -> DataFrame:
    """Per site means and sums from the score, issue and cascade tables
    (aggregate each, then join on the site key), with a DQI tier."""
    k = ["study_id", "site_id"]
    a = scores.groupBy(*k).agg(F.count(F.lit(1)).alias("patients"), F.avg("dqi_score").alias("dqi_mean"),
                               F.count(F.when(F.col("dblock_tier1_ready"), 1)).alias("ready"))
    b = issues.groupBy(*k).agg(F.sum("total_issues").alias("issues"), F.sum("count_open_queries").alias("open_queries"))
    c = cascade.groupBy(*k).agg(F.avg("cascade_impact_score").alias("cascade_mean"))
    x = a.join(b, k).join(c, k)
    tier = F.when(F.col("dqi_mean") >= 95, "Pristine").when(F.col("dqi_mean") >= 85, "Excellent") \
        .when(F.col("dqi_mean") >= 75, "Good").otherwise("Needs Attention")
    return x.withColumn("quality_tier", tier)


def role_portfolio(scores: DataFrame, issues: DataFrame, sites: Sequence[str]) -> DataFrame:
    """Portfolio of a role over a site list: totals from each table
    (filtered by IN), one-row aggregates side by side."""
    s = scores.filter(F.col("site_id").isin(list(sites)))
    i = issues.filter(F.col("site_id").isin(list(sites)))
    a = s.agg(F.count(F.lit(1)).alias("patients"), F.count_distinct("site_id").alias("sites"),
              F.avg("dqi_score").alias("dqi_mean"), F.count(F.when(F.col("tier2_clean"), 1)).alias("clean"),
              F.count(F.when(F.col("dblock_tier1_ready"), 1)).alias("ready"))
    b = i.agg(F.sum("total_issues").alias("issues"), F.count(F.when(F.col("priority_tier") == "critical", 1)).alias("critical"))
    return a.crossJoin(b)


def path_to_lock(scores: DataFrame) -> DataFrame:
    """A69 (1): per study ready share of eligible, gap to 95 % and days at
    0.5 percentage points per day."""
    e = scores.filter(F.col("dblock_eligible"))
    s = e.groupBy("study_id").agg(F.count(F.when(F.col("dblock_tier1_ready"), 1)).alias("current_ready"),
                                  (F.avg(F.col("dblock_tier1_ready").cast("double")) * 100).alias("current_ready_pct"))
    gap = F.lit(config.LOCK_TARGET_READY_PCT) - F.col("current_ready_pct")
    days = F.when(gap > 0, F.greatest(F.lit(1), F.floor(gap / config.LOCK_DAILY_IMPROVEMENT).cast("int"))).otherwise(0)
    return s.select("*", gap.alias("gap_pct"), days.alias("days_to_target"))


def lock_blockers(issues: DataFrame, top: int = 5) -> DataFrame:
    """A69 (2): per study the five most frequent issue types with owner,
    impact, effort (count x hours per item) and days (effort / 8, >= 1)."""
    one = issues.groupBy("study_id").agg(*[F.sum(f"issue_{t}").alias(t) for t in TYPES])
    rows = one.select("study_id", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(t).alias("issue_type"),
                                                                F.col(t).cast("long").alias("count")) for i, t in enumerate(TYPES)]))
                      .alias("r")).select("study_id", "r.*").filter(F.col("count") > 0)
    w = Window.partitionBy("study_id").orderBy(F.col("count").desc(), F.col("o").asc())
    rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    info = F.create_map(*[x for k, (r, imp, e) in config.BLOCKER_INFO.items() for x in (F.lit(k), F.struct(
        F.lit(r).alias("r"), F.lit(imp).alias("i"), F.lit(e).alias("e")))])
    d = config.BLOCKER_DEFAULT
    b = F.coalesce(info[F.col("issue_type")], F.struct(F.lit(d[0]).alias("r"), F.lit(d[1]).alias("i"), F.lit(d[2]).alias("e")))
    cnt = F.col("count")
    effort = cnt * b["e"]
    return rows.select("study_id", "rank", F.initcap(F.regexp_replace("issue_type", "_", " ")).alias("issue_type"), "count",
                       F.least(cnt, F.floor(cnt * 0.8).cast("long")).alias("patients_affected"), b["r"].alias("responsible"),
                       b["i"].alias("impact"), effort.alias("effort_hours"),
                       F.greatest(F.lit(1), F.floor(effort / 8).cast("int")).alias("days_to_resolve"))


def work_items(recs: DataFrame, as_of: dt.date) -> DataFrame:
    """One task per (site, issue type): action, owner, patients, effort,
    priority and due date from the issue type's SLA days."""
    sla = F.create_map(*[x for t in TYPES for x in (F.lit(t), F.lit(META[t][5]))])
    g = recs.groupBy("site_id", "issue_type").agg(F.min("recommended_action").alias("task"),
                                                  F.min("responsible_role").alias("owner"),
                                                  F.count_distinct("patient_key").alias("patients"),
                                                  F.sum("estimated_effort_hours").alias("effort_hours"),
                                                  F.min("issue_rank").alias("best_rank"))
    return g.select("*", F.when(F.col("best_rank") == 1, "high").otherwise("normal").alias("priority"),
                    F.date_add(F.lit(as_of), sla[F.col("issue_type")]).alias("due_date"))


def update_triggers(trust: DataFrame, signals: DataFrame, pending: DataFrame) -> DataFrame:
    """Model-update triggers from the trust metrics, learning signals
    and the pending feedback count."""
    t = config.UPDATE_TRIGGERS
    s = signals.agg(F.count(F.when((F.col("signal_type") == "calibration") & (F.col("strength") > t["calibration_signal_size"]), 1))
                    .alias("_cal"))
    x = trust.crossJoin(s).crossJoin(pending)
    c = F.col
    rules = F.array(
        F.when(F.when(c("total_interactions") > 0, c("rejected") / c("total_interactions")).otherwise(0.0) > t["rejection_rate"],
               F.lit("rejection_rate")),
        F.when(c("override_rate") > t["override_rate"], F.lit("override_rate")),
        F.when(c("pending") >= t["pending_feedback"], F.lit("pending_feedback")),
        F.when(c("_cal") >= t["calibration_signals"], F.lit("calibration_signals")))
    return x.select(F.explode(F.array_compact(rules)).alias("trigger"))


def run_statistics(runs: DataFrame, latest: int = 100) -> DataFrame:
    """Runs by status and type with mean duration, plus the success rate
    of the latest 100 runs (ordered limit, then aggregate)."""
    by = runs.groupBy("status", "run_type").agg(F.count(F.lit(1)).alias("runs"), F.avg("duration_s").alias("mean_duration_s"))
    last = runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(latest) \
        .agg(F.avg((F.col("status") == "success").cast("double")).alias("recent_success_rate"))
    return by.crossJoin(last)


def group_features(matches: DataFrame, site: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and std of site features per (study, pattern)."""
    x = matches.select("pattern_id", "study_id", F.col("entity_id").alias("site_id")).join(site, ["study_id", "site_id"])
    return x.groupBy("study_id", "pattern_id").agg(F.count(F.lit(1)).alias("sites"),
                                                   *[F.avg(c).alias(f"{c}_mean") for c in cols],
                                                   *[F.stddev_samp(c).alias(f"{c}_std") for c in cols])


def tag_statistics(tags: DataFrame) -> DataFrame:
    """Tags by type: occurrences, distinct values, documents."""
    return tags.groupBy("tag_type").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("value").alias("distinct_tags"),
                                        F.count_distinct("doc_id").alias("documents"))


def impute(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """M3: exact median for numeric columns, mode (ties -> smallest) for
    categorical ones."""
    median = exact_quantiles(df, numeric, [0.5])
    stats = df.agg(F.count("*").alias("_n"), *[F.mode(c, deterministic=True).alias(f"{c}__mode") for c in categorical])
    x = df.crossJoin(F.broadcast(stats))
    return x.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(median[c][0])).alias(c) for c in numeric],
                    *[F.coalesce(F.col(c), F.col(f"{c}__mode")).alias(c) for c in categorical])


def quantile_baseline(train: DataFrame, cells: Sequence[str], target: str) -> DataFrame:
    """p10 / p50 / p90 of the target per feature cell (exact)."""
    q = group_quantiles(train, cells, target, [0.1, 0.5, 0.9]).toDF(*cells, "p10", "p50", "p90")
    return train.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).join(q, list(cells))


def interval_metrics(pred: DataFrame, target: str, cls: str) -> DataFrame:
    """Coverage of [p10, p90], MAE and RMSE of p50, mean width, per
    class and overall (rollup)."""
    c = F.col
    r = pred.rollup(cls).agg(F.count(F.lit(1)).alias("n"),
                             F.avg(((c(target) >= c("p10")) & (c(target) <= c("p90"))).cast("double")).alias("coverage"),
                             F.avg(F.abs(c(target) - c("p50"))).alias("mae"),
                             F.sqrt(F.avg((c(target) - c("p50")) * (c(target) - c("p50")))).alias("rmse"),
                             F.avg(c("p90") - c("p10")).alias("mean_width"))
    return r.withColumn(cls, F.coalesce(c(cls), F.lit("overall")))


def oversample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Every class brought to the size of the largest by replicating
    rows (replica r = 0, 1, ...) and keeping the first `target` per class in
    md5(key, r) order; exact class balance, deterministic."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    target = n.agg(F.max("_n").alias("_t"))
    x = df.join(F.broadcast(n), label).crossJoin(F.broadcast(target))
    x = x.withColumn("replica", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_t") / F.col("_n")) - 1).cast("int"))))
    x = x.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("replica").cast("string"))))
    x = ordered_row_number(x, [label], ["_h"], "_rn")
    return x.filter(F.col("_rn") <= F.col("_t")).drop("_n", "_t", "_h", "_rn")


def bottlenecks(issues: DataFrame, top: int = 10) -> DataFrame:
    """Patients per issue type (count > 0), blocking score = floor(patients
    x impact / 100), downstream blocked = floor(patients x multiplier); only
    types with patients; top n by blocking score (ties: declared order)."""
    one = issues.agg(*[F.count(F.when(F.col(f"count_{t}") > 0, 1)).alias(t) for t, _, _ in config.BOTTLENECKS])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(t).alias("issue_type"), F.lit(n).alias("issue_name"),
                                                   F.lit(imp).alias("impact_score"), F.col(t).alias("patient_count"))
                                          for i, (t, n, imp) in enumerate(config.BOTTLENECKS)])).alias("r")).select("r.*")
    mult = F.create_map(*[x for k, v in config.DOWNSTREAM_MULTIPLIERS.items() for x in (F.lit(k), F.lit(v))])
    pc = F.col("patient_count")
    x = rows.filter(pc > 0).select("o", "issue_type", "issue_name", "impact_score", "patient_count",
                                   F.floor(pc * F.col("impact_score") / 100).cast("long").alias("blocking_score"),
                                   F.floor(pc * F.coalesce(mult[F.col("issue_type")], F.lit(1.0))).cast("long").alias("downstream_blocked"))
    return x.orderBy(F.col("blocking_score").desc(), "o").limit(top).drop("o")


def site_progress(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """Per site patients, tier-2 clean, lock-ready, open issues (sum of
    the issue counts), mean DQI, completion rate and a trend label (mean DQI
    >= 90 improving, < 75 declining)."""
    k = ["study_id", "site_id"]
    a = scores.groupBy(*k).agg(F.count(F.lit(1)).alias("total_patients"),
                               F.count(F.when(F.col("tier2_clean"), 1)).alias("clean_patients"),
                               F.count(F.when(F.col("dblock_tier1_ready"), 1)).alias("db_lock_ready"),
                               F.avg("dqi_score").alias("dqi_score"))
    total = None
    for t in TYPES:
        term = F.coalesce(F.col(f"count_{t}"), F.lit(0.0))
        total = term if total is None else total + term
    b = issues.groupBy(*k).agg(F.sum(total).alias("open_issues"))
    x = a.join(b, k, "left")
    trend = F.when(F.col("dqi_score") >= 90, "improving").when(F.col("dqi_score") < 75, "declining").otherwise("stable")
    return x.select("*", (F.col("clean_patients") / F.col("total_patients") * 100).alias("completion_rate"), trend.alias("trend"))
