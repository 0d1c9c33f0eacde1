"""Report views.

Every view is an aggregate or a filter + ordered limit over the score
tables; limits appear only where the report is a top-N list and run as
TakeOrderedAndProject (each task keeps N rows)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import epoch_micros, first_true, ntz_lit
from quarry.functions.quantiles import group_quantiles


def portfolio_rollup(df: DataFrame) -> DataFrame:
    """Portfolio, study and site summaries in one pass (ROLLUP), their
    medians from counts of the distinct scores."""
    c = F.col
    median = None
    for keys in (["study_id", "site_id"], ["study_id"], []):
        one = group_quantiles(df, keys, "dqi_score", [0.5]).withColumns({k: F.lit(None).cast("string") for k in ("study_id", "site_id") if k not in keys})
        one = one.select(F.col("study_id").alias("_study"), F.col("site_id").alias("_site"), F.lit(2 - len(keys)).alias("_level"), F.col("q0").alias("dqi_median"))
        median = one if median is None else median.unionByName(one)
    r = df.rollup("study_id", "site_id").agg(
        F.count(F.lit(1)).alias("patients"), F.avg("dqi_score").alias("dqi_mean"),
        F.stddev_samp("dqi_score").alias("dqi_std"),
        F.min("dqi_score").alias("dqi_min"), F.max("dqi_score").alias("dqi_max"),
        F.count(F.when(c("tier1_clean"), 1)).alias("tier1_clean"), F.count(F.when(c("tier2_clean"), 1)).alias("tier2_clean"),
        F.count(F.when(c("dblock_tier1_ready"), 1)).alias("ready"), F.grouping_id().alias("_g"))
    level = F.when(c("_g") == 3, "portfolio").when(c("_g") == 1, "study").otherwise("site")
    depth = F.when(c("_g") == 3, 2).when(c("_g") == 1, 1).otherwise(0)
    same = c("study_id").eqNullSafe(c("_study")) & c("site_id").eqNullSafe(c("_site")) & (depth == c("_level"))
    return r.withColumn("level", level).join(median, same, "left").drop("_g", "_study", "_site", "_level")


def regional_metrics(df: DataFrame) -> DataFrame:
    """Patients, distinct sites and mean score per region."""
    return df.groupBy("region").agg(F.count(F.lit(1)).alias("patients"), F.count_distinct("site_id").alias("sites"),
                                    F.coalesce(F.avg("dqi_score"), F.lit(0.0)).alias("dqi_mean"))


def band_histogram(df: DataFrame, score: str = "dqi_score") -> DataFrame:
    """Patients per DQI band including empty bands (band table LEFT
    JOIN counts), with the share of all patients."""
    spark = df.sparkSession
    bands = [(lab, thr, i) for i, (thr, lab) in enumerate(config.DQI_BANDS)] + [(config.DQI_BAND_FLOOR, 0.0, len(config.DQI_BANDS))]
    b = spark.createDataFrame(bands, "band string, lower double, ordinal int")
    from quarry.functions.exprs import band
    counts = df.groupBy(band(F.col(score), config.DQI_BANDS, config.DQI_BAND_FLOOR).alias("band")) \
        .agg(F.count(F.lit(1)).alias("patients"))
    tot = df.agg(F.count(F.lit(1)).alias("_n"))
    x = F.broadcast(b).join(counts, "band", "left").crossJoin(tot)
    return x.select("band", "ordinal", "lower", F.coalesce("patients", F.lit(0)).alias("patients"),
                    F.when(F.col("_n") > 0, F.coalesce("patients", F.lit(0)) * 100.0 / F.col("_n")).otherwise(0.0).alias("pct"))


def top_bottom_sites(site: DataFrame, metric: str = "site_dqi_mean", n: int = 10) -> DataFrame:
    """O2: the n best and n worst sites by a metric (ties by site)."""
    top = site.orderBy(F.col(metric).desc(), "study_id", "site_id").limit(n).withColumn("list", F.lit("top"))
    bottom = site.orderBy(F.col(metric).asc(), "study_id", "site_id").limit(n).withColumn("list", F.lit("bottom"))
    return top.unionByName(bottom)


def work_queue(issues: DataFrame, scores: DataFrame, cascade: DataFrame, n: int = 20) -> DataFrame:
    """Patients with issues ranked by tier points + (100 - DQI) x 0.5 +
    cascade impact x 0.3 + issues x 2; top n."""
    tier = F.create_map(*[x for k, v in config.QUEUE_TIER_POINTS.items() for x in (F.lit(k), F.lit(v))])
    x = issues.filter(F.col("total_issues") > 0).select(
        "patient_key", "site_id", "priority_tier", "total_issues", *[f"issue_{t}" for t in config.QUEUE_PRIMARY_ISSUES])
    x = x.join(scores.select("patient_key", "dqi_score"), "patient_key", "left") \
        .join(cascade.select("patient_key", "cascade_impact_score"), "patient_key", "left")
    dqi = F.coalesce(F.col("dqi_score"), F.lit(100.0))
    casc = F.coalesce(F.col("cascade_impact_score"), F.lit(0.0))
    score = F.coalesce(tier[F.lower(F.col("priority_tier"))], F.lit(0)).cast("double") + (F.lit(100.0) - dqi) * 0.5 \
        + casc * 0.3 + F.col("total_issues") * 2
    prim = first_true([(F.col(f"issue_{t}") == 1, t) for t in config.QUEUE_PRIMARY_ISSUES], "other")
    q = x.select("patient_key", "site_id", "priority_tier", dqi.alias("dqi_score"), casc.alias("cascade_impact"),
                 "total_issues", score.alias("queue_score"), prim.alias("primary_issue"))
    return q.orderBy(F.col("queue_score").desc(), F.col("patient_key").asc()).limit(n)


def sae_cases(alerts: DataFrame, as_of) -> DataFrame:
    """Safety cases: safety-category alerts; onset = creation time."""
    now = ntz_lit(as_of)
    x = alerts.filter(F.col("category") == "safety")
    elapsed = (epoch_micros(now) - epoch_micros(F.col("created_at"))) / 3.6e9
    return x.select("alert_id", "recipient_id", "created_at", "value", elapsed.alias("hours_elapsed"),
                    (F.lit(float(config.SAE_SLA_HOURS)) - elapsed).alias("hours_remaining"))


def sla_class(cases: DataFrame) -> DataFrame:
    """Breached / critical (<24 h left) / warning (<48 h) / safe and a
    piecewise-linear breach probability."""
    h = F.col("hours_remaining")
    status = F.when(h < 0, "breached").when(h < 24, "critical").when(h < 48, "warning").otherwise("safe")
    prob = (F.when(h < 0, 1.0).when(h < 24, F.lit(0.75) + (F.lit(24.0) - h) / 24 * 0.20)
            .when(h < 48, F.lit(0.30) + (F.lit(48.0) - h) / 24 * 0.45)
            .otherwise(F.greatest(F.lit(0.05), F.lit(0.30) - h / 100)))
    return cases.select("*", status.alias("sla_status"), prob.alias("breach_probability"))


def case_timeline(cases: DataFrame) -> DataFrame:
    """Cases per day, serious ones (value > 200) counted apart."""
    return cases.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("value") > 200, 1)).alias("serious"))


def query_load(df: DataFrame, n: int = 20) -> DataFrame:
    """Open queries per site, top n."""
    s = df.groupBy("study_id", "site_id").agg(F.sum("total_queries").alias("open_queries"),
                                              F.count(F.lit(1)).alias("patients"))
    return s.orderBy(F.col("open_queries").desc(), "study_id", "site_id").limit(n)


def readiness_by_status(df: DataFrame) -> DataFrame:
    """Eligible patients by status: ready, pending, blocked and blocker
    sums."""
    c = F.col
    e = df.filter(c("dblock_eligible"))
    return e.groupBy("subject_status_clean").agg(
        F.count(F.lit(1)).alias("patients"), F.count(F.when(c("dblock_status") == "Ready", 1)).alias("ready"),
        F.count(F.when(c("dblock_status") == "Pending", 1)).alias("pending"),
        F.count(F.when(c("dblock_status") == "Blocked", 1)).alias("blocked"),
        F.sum("dblock_blocker_count").alias("blockers"), F.sum("dblock_critical_count").alias("critical_blockers"))


def quick_wins(df: DataFrame, max_effort: float = 4.0, min_impact: float = 30.0, n: int = 10) -> DataFrame:
    """Patients whose remaining effort is at most `max_effort` hours and
    whose cascade impact is at least `min_impact`, by impact per hour."""
    c = F.col
    x = df.filter((c("total_effort_hours") > 0) & (c("total_effort_hours") <= max_effort)
                  & (c("cascade_impact_score") >= min_impact))
    x = x.select("patient_key", "site_id", "cascade_impact_score", "total_effort_hours",
                 (c("cascade_impact_score") / c("total_effort_hours")).alias("impact_per_hour"))
    return x.orderBy(c("impact_per_hour").desc(), c("patient_key").asc()).limit(n)
