"""Hierarchy rollups: site performance (A8), study metrics (A9), global
summary (A10) and friends.

All of them are `groupBy().agg()` with decomposable aggregates, so Spark
combines map-side before the shuffle: a site holding a third of all
patients costs one partial-aggregate row per task, not a hot reducer.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import band, clip, round_half_even


def _rate(count_col: str, n_col: str = "patient_count"):
    return round_half_even(F.col(count_col) / F.col(n_col) * 100.0, 1)


def site_performance(df: DataFrame, keys: tuple[str, ...] = ("study_id", "site_id")) -> DataFrame:
    """Per-site DQI stats, clean and ready counts and rates (1 dp, half
    even), weighted site performance index (2 dp) and tier."""
    c = F.col
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("patient_count"),
        F.avg("dqi_score").alias("site_dqi_mean"),
        F.min("dqi_score").alias("site_dqi_min"),
        F.max("dqi_score").alias("site_dqi_max"),
        F.stddev_samp("dqi_score").alias("site_dqi_std"),
        F.count(F.when(c("tier1_clinical_clean"), 1)).alias("tier1_clean_count"),
        F.count(F.when(c("tier2_operational_clean"), 1)).alias("tier2_clean_count"),
        F.count(F.when(c("db_lock_tier1_ready"), 1)).alias("db_lock_ready_count"),
        F.sum("total_queries").alias("total_queries"),
        F.sum("total_issues_all_sources").alias("total_issues"),
    )
    agg = agg.select("*", _rate("tier1_clean_count").alias("tier1_clean_rate"),
                     _rate("tier2_clean_count").alias("tier2_clean_rate"),
                     _rate("db_lock_ready_count").alias("db_lock_ready_rate"))
    w = config.SPI_WEIGHTS
    spi = (c("site_dqi_mean") * w["site_dqi_mean"] + c("tier1_clean_rate") * w["tier1_clean_rate"]
           + c("tier2_clean_rate") * w["tier2_clean_rate"] + c("db_lock_ready_rate") * w["db_lock_ready_rate"])
    agg = agg.withColumn("site_performance_index", round_half_even(clip(spi, 0.0, 100.0), 2))
    return agg.withColumn("performance_tier", band(c("site_performance_index"), config.SPI_TIERS,
                                                   config.SPI_TIER_FLOOR))


def _b(x, d):
    return round_half_even(x, d)


def site_clean_summary(df: DataFrame, keys=("study_id", "site_id")) -> DataFrame:
    """Clean counts and rates, quick wins, effort per not-clean patient,
    readiness score (0.4 / 0.4 / 0.2) and tier."""
    c = F.col
    a = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("patient_count"),
        F.count(F.when(c("tier1_clean"), 1)).alias("tier1_clean_count"),
        F.count(F.when(c("tier2_clean"), 1)).alias("tier2_clean_count"),
        F.sum("tier1_effort_hours").alias("tier1_effort_hours"),
        F.sum("tier2_effort_hours").alias("tier2_effort_hours"),
        F.sum("total_effort_hours").alias("total_effort_hours"),
        F.count(F.when(c("is_quick_win"), 1)).alias("quick_win_count"))
    n = c("patient_count")
    a = a.select("*", _b(c("tier1_clean_count") / n * 100.0, 1).alias("tier1_clean_rate"),
                 _b(c("tier2_clean_count") / n * 100.0, 1).alias("tier2_clean_rate"),
                 _b(c("quick_win_count") / n * 100.0, 1).alias("quick_win_rate"))
    not_clean = n - c("tier2_clean_count")
    a = a.select("*", F.when(not_clean > 0, _b(c("total_effort_hours") / not_clean, 2)).otherwise(0.0)
                 .alias("avg_effort_per_patient"),
                 _b(c("tier1_clean_rate") * 0.4 + c("tier2_clean_rate") * 0.4 + c("quick_win_rate") * 0.2, 1)
                 .alias("site_readiness_score"))
    return a.withColumn("readiness_tier", band(c("site_readiness_score"), config.READINESS_TIERS,
                                               config.READINESS_TIER_FLOOR))


def blocking_summary(df: DataFrame) -> DataFrame:
    """Per clean criterion: failures, issues, effort; tier-2 issues
    count only tier-1-clean patients; ordered by tier, priority."""
    c = F.col
    aggs = []
    for tier, cid, *_ in config.CLEAN_CRITERIA:
        p = f"t{tier}_{cid}"
        fail = ~c(p)
        scope = fail if tier == 1 else (fail & c("tier1_clean"))
        aggs += [F.count(F.when(fail, 1)).alias(f"{p}__f"),
                 F.coalesce(F.sum(F.when(scope, c(f"{p}_count"))), F.lit(0.0)).cast("long").alias(f"{p}__i"),
                 (F.coalesce(F.sum(c(f"{p}_effort_hrs")), F.lit(0.0)) if tier == 1 else F.lit(0.0)).alias(f"{p}__e")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(tier).alias("tier"), F.lit(cid).alias("criterion_id"), F.lit(name).alias("name"),
                     F.lit("Hard Block" if tier == 1 else "Soft Block").alias("block_type"),
                     F.col(f"t{tier}_{cid}__f").alias("failures"), F.col(f"t{tier}_{cid}__i").alias("total_issues"),
                     F.col(f"t{tier}_{cid}__e").alias("effort_hours"), F.lit(prio).alias("priority"),
                     F.lit(role).alias("responsible"), F.lit(act).alias("action"))
            for tier, cid, name, _, _, prio, role, act in config.CLEAN_CRITERIA]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def study_lock_projection(df: DataFrame, as_of) -> DataFrame:
    """Per study counts, mean / median / max days to ready, ready rate
    over eligible (1 dp), tier, estimated lock date = as_of + max days."""
    c = F.col
    a = df.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count(F.when(c("dblock_eligible"), 1)).alias("eligible"),
        F.count(F.when(c("dblock_tier1_ready"), 1)).alias("ready"),
        F.count(F.when(c("dblock_tier2_pending"), 1)).alias("pending"),
        F.avg("dblock_days_to_ready").alias("avg_days"),
        F.percentile("dblock_days_to_ready", 0.5).alias("median_days"),
        F.max("dblock_days_to_ready").alias("max_days"))
    rate = F.when(c("eligible") > 0, _b(c("ready") / c("eligible") * 100.0, 1))
    a = a.withColumn("ready_rate", rate)
    tier = F.when(c("ready_rate").isNull() | (c("eligible") == 0), "No Eligible Patients")
    for thr, label in config.STUDY_LOCK_TIERS:
        tier = tier.when(c("ready_rate") >= thr, label)
    secs = F.round(F.coalesce(c("max_days"), F.lit(0.0)) * 86400.0).cast("long")
    # wall-clock arithmetic on TIMESTAMP_NTZ: no session time zone involved
    base = F.lit(str(as_of)).cast("timestamp_ntz")
    return a.select("*", tier.otherwise("Not Ready").alias("lock_tier"),
                    F.timestamp_add("SECOND", secs, base).alias("est_lock_date"))


def site_lock_projection(df: DataFrame) -> DataFrame:
    """Per site: ready rate over eligible (100 when none), priority."""
    c = F.col
    a = df.groupBy("study_id", "site_id").agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count(F.when(c("dblock_eligible"), 1)).alias("eligible"),
        F.count(F.when(c("dblock_tier1_ready"), 1)).alias("ready"),
        F.avg("dblock_days_to_ready").alias("avg_days"),
        F.sum("dblock_blocker_count").alias("total_blockers"))
    a = a.withColumn("ready_rate", F.when(c("eligible") > 0, _b(c("ready") / c("eligible") * 100.0, 1))
                     .otherwise(100.0))
    return a.withColumn("priority_score", F.lit(100.0) - c("ready_rate"))


def trial_state_rollup(df: DataFrame) -> DataFrame:
    """Patients -> sites -> studies: site counts and means first, then
    study totals and means of the site figures (two aggregation levels)."""
    c = F.col
    site = df.groupBy("study_id", "site_id").agg(
        F.count(F.lit(1)).alias("patients"), F.avg("dqi_score").alias("site_dqi"),
        F.avg(c("tier2_clean").cast("double")).alias("site_clean_rate"),
        F.avg(c("dblock_tier1_ready").cast("double")).alias("site_ready_rate"))
    return site.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("sites"), F.sum("patients").alias("patients"), F.avg("site_dqi").alias("mean_site_dqi"),
        F.min("site_dqi").alias("worst_site_dqi"), F.avg("site_clean_rate").alias("mean_site_clean_rate"),
        F.avg("site_ready_rate").alias("mean_site_ready_rate"),
        F.count(F.when(c("site_dqi") < 75, 1)).alias("sites_below_75"))
