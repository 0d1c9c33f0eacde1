"""Site benchmarking (A17, W1-W7, A18, D23) and patient-vs-site.

Site-level frames are small (one row per site); peer statistics use
windows partitioned by the peer group.  Global statistics are one-row
aggregates broadcast back; global ranks go through `histogram_rank`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import band, pct_rank_avg, round_half_even
from quarry.functions.ranking import histogram_rank


def site_size(n):
    expr = None
    for lo, hi, label in config.SITE_SIZE_BINS:
        cond = (n >= lo) & (n <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise("Unknown")


def site_base(df: DataFrame) -> DataFrame:
    """Per-site base table with rates and a size band."""
    c = F.col
    has = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("patient_count")]
    opt = [("dqi_score", F.avg, "dqi_mean"), ("total_queries", F.sum, "total_queries"),
           ("crfs_require_verification_sdv", F.sum, "sdv_pending"), ("crfs_never_signed", F.sum, "unsigned_crfs"),
           ("dblock_days_to_ready", F.avg, "avg_days_to_ready")]
    aggs += [fn(src).alias(dst) for src, fn, dst in opt if src in has]
    for src, dst in [("tier1_clean", "tier1_clean_count"), ("tier2_clean", "tier2_clean_count"),
                     ("dblock_tier1_ready", "ready_count")]:
        if src in has:
            aggs.append(F.count(F.when(c(src), 1)).alias(dst))
    if "cascade_impact_score" in has:
        aggs += [F.avg("cascade_impact_score").alias("cascade_mean"),
                 F.sum("cascade_impact_score").alias("cascade_total")]
    for k in ("region", "country"):
        if k in has:
            aggs.append(F.min(k).alias(k))
    s = df.groupBy("study_id", "site_id").agg(*aggs)
    pc = c("patient_count")
    extra = []
    if "tier1_clean" in has:
        extra.append(round_half_even(c("tier1_clean_count") / pc * 100.0, 1).alias("tier1_clean_rate"))
    if "tier2_clean" in has:
        extra.append(round_half_even(c("tier2_clean_count") / pc * 100.0, 1).alias("tier2_clean_rate"))
    if "dblock_tier1_ready" in has:
        extra.append(round_half_even(c("ready_count") / pc * 100.0, 1).alias("ready_rate"))
    if "total_queries" in has:
        extra.append(round_half_even(c("total_queries") / pc, 2).alias("queries_per_patient"))
    if "cascade_impact_score" in has:
        extra.append(round_half_even(c("cascade_total") / pc, 2).alias("cascade_density"))
    return s.select("*", *extra, (pc < config.MIN_PATIENTS_FULL_SCORE).alias("is_small_site"),
                    site_size(pc).alias("site_size"))


def peer_benchmarks(site: DataFrame, metrics=tuple(config.BENCH_METRICS), peers=tuple(config.BENCH_PEERS)) -> DataFrame:
    """Peer mean / std / median / percentile (x100) / delta.

    Unpivot to (peer, peer value, metric, value), compute every statistic
    with ONE window partition spec, pivot back with explicit column names.
    The average-tie percentile is (rank_min + rank_max) / 2 / n, where
    rank_max is a RANGE-frame count in the same ordered window.
    """
    ms = [m for m in metrics if m in site.columns]
    ps = [(p, cols) for p, cols in peers if all(c in site.columns for c in cols)]
    items = [F.struct(F.lit(p).alias("peer"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("pk"),
                      F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
             for p, cols in ps for m in ms]
    long = site.select("study_id", "site_id", F.explode(F.array(*items)).alias("x")).select("study_id", "site_id", "x.*")
    w_all = Window.partitionBy("peer", "pk", "metric")
    w_ord = w_all.orderBy(F.col("v").asc_nulls_last())
    rmax = F.count("v").over(w_ord.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    long = long.select("study_id", "site_id", "peer", "metric", "v",
                       F.avg("v").over(w_all).alias("mean"), F.stddev_samp("v").over(w_all).alias("std"),
                       F.percentile(F.col("v"), 0.5).over(w_all).alias("median"),
                       F.when(F.col("v").isNull(), F.lit(None).cast("double"))
                       .otherwise((F.rank().over(w_ord) + rmax) / 2.0 / F.count("v").over(w_all) * 100.0).alias("pctl"))
    stats = ["mean", "std", "median", "pctl", "vs_mean"]
    cells = long.select("study_id", "site_id", F.explode(F.array(*[
        F.struct(F.concat_ws("_", "metric", "peer", F.lit(st)).alias("name"),
                 ((F.col("v") - F.col("mean")) if st == "vs_mean" else F.col(st)).alias("val"))
        for st in stats])).alias("c")).select("study_id", "site_id", "c.name", "c.val")
    names = [f"{m}_{p}_{st}" for p, _ in ps for m in ms for st in stats]
    wide = cells.groupBy("study_id", "site_id").pivot("name", names).agg(F.first("val"))
    return site.join(wide, ["study_id", "site_id"], "left")


def site_rankings(site: DataFrame) -> DataFrame:
    """Composite score (normalised, reweighted, shrunk to the mean for
    small sites), overall / study / region rank (min, descending),
    percentile and tier."""
    c = F.col
    wts = config.COMPOSITE_WEIGHTS
    stats = site.agg(F.min("dqi_mean").alias("_dmin"), F.max("dqi_mean").alias("_dmax"),
                     F.max("queries_per_patient").alias("_qmax"), F.max("avg_days_to_ready").alias("_tmax"))
    s = site.crossJoin(F.broadcast(stats))
    dqi_norm = F.when(c("_dmax") > c("_dmin"), (c("dqi_mean") - c("_dmin")) / (c("_dmax") - c("_dmin")) * 100.0) \
        .otherwise(F.lit(100.0))
    q_norm = F.when(c("_qmax") > 0, (F.lit(1.0) - c("queries_per_patient") / c("_qmax")) * 100.0).otherwise(F.lit(100.0))
    d_norm = F.when(c("_tmax") > 0, (F.lit(1.0) - F.coalesce(c("avg_days_to_ready"), F.lit(0.0)) / c("_tmax")) * 100.0) \
        .otherwise(F.lit(100.0))
    s = s.select(*site.columns, dqi_norm.alias("dqi_norm"), q_norm.alias("queries_norm"), d_norm.alias("days_norm"))
    total_w = sum(wts.values())
    score = (c("dqi_norm") * wts["dqi"] + F.coalesce(c("tier2_clean_rate"), F.lit(0.0)) * wts["tier2"]
             + F.coalesce(c("ready_rate"), F.lit(0.0)) * wts["ready"]
             + F.coalesce(c("queries_norm"), F.lit(0.0)) * wts["queries"]
             + F.coalesce(c("days_norm"), F.lit(0.0)) * wts["days"])
    s = s.withColumn("composite_score_raw", round_half_even(score / F.lit(total_w), 1))
    mean = s.agg(F.avg("composite_score_raw").alias("_mean"))
    conf = F.least(c("patient_count") / float(config.MIN_PATIENTS_FULL_SCORE), F.lit(1.0))
    s = s.crossJoin(F.broadcast(mean)).withColumn(
        "composite_score", round_half_even(c("composite_score_raw") * conf + c("_mean") * (F.lit(1.0) - conf), 1)).drop("_mean")
    s = histogram_rank(s, "composite_score", ascending=False, prefix="_all")
    s = s.withColumnRenamed("_all_rank_min", "overall_rank").drop("_all_rank_avg", "_all_pct")
    s = histogram_rank(s, "composite_score", ascending=True, prefix="_pc")
    s = s.withColumn("composite_percentile", c("_pc_pct") * 100.0).drop("_pc_rank_min", "_pc_rank_avg", "_pc_pct")
    s = s.withColumn("study_rank", F.rank().over(Window.partitionBy("study_id").orderBy(c("composite_score").desc())))
    if "region" in site.columns:
        s = s.withColumn("region_rank", F.rank().over(Window.partitionBy("region").orderBy(c("composite_score").desc())))
    return s.withColumn("performance_tier", band(c("composite_percentile"), config.SITE_TIERS_BY_PCTL,
                                                 config.SITE_TIER_FLOOR))


def site_outliers(site: DataFrame, metrics=tuple(config.BENCH_METRICS), z: float = config.OUTLIER_Z) -> DataFrame:
    """Z-score per metric (2 dp) against the global mean / std; any and
    count of |z| > 2.5.  z is null where std is 0."""
    ms = [m for m in metrics if m in site.columns]
    stats = site.agg(*[F.avg(m).alias(f"_mu_{m}") for m in ms], *[F.stddev_samp(m).alias(f"_sd_{m}") for m in ms])
    s = site.crossJoin(F.broadcast(stats))
    zc = {m: F.when(F.col(f"_sd_{m}") > 0, round_half_even((F.col(m) - F.col(f"_mu_{m}")) / F.col(f"_sd_{m}"), 2))
          for m in ms}
    s = s.select(*site.columns, *[zc[m].alias(f"{m}_zscore") for m in ms])
    flags = [F.coalesce(F.abs(F.col(f"{m}_zscore")) > z, F.lit(False)) for m in ms]
    s = s.select("*", *[f.alias(f"{m}_outlier") for f, m in zip(flags, ms)])
    cnt = sum((F.col(f"{m}_outlier").cast("int") for m in ms[1:]), F.col(f"{ms[0]}_outlier").cast("int"))
    return s.select("*", (cnt > 0).alias("is_any_outlier"), cnt.alias("outlier_count"))


def patient_vs_site(df: DataFrame, metrics=("dqi_score", "total_queries"), keys=("study_id", "site_id")) -> DataFrame:
    """Each patient against its own site: site mean / std (groupBy +
    join, map-side combined), delta and within-site percentile (histogram
    rank), never one window holding a whole site."""
    k = list(keys)
    out = df
    for m in metrics:
        st = df.groupBy(*k).agg(F.avg(m).alias(f"{m}_site_mean"), F.stddev_samp(m).alias(f"{m}_site_std"))
        out = out.join(st, k, "left")
        out = out.withColumn(f"{m}_vs_site", F.col(m) - F.col(f"{m}_site_mean"))
        out = histogram_rank(out, m, k, ascending=True, prefix=f"_{m}")
        out = out.withColumn(f"{m}_site_pctl", F.col(f"_{m}_pct") * 100.0) \
            .drop(f"_{m}_rank_min", f"_{m}_rank_avg", f"_{m}_pct")
    return out


def study_benchmarks(site: DataFrame) -> DataFrame:
    """Study means of site metrics, rank (min, desc), percentile, tier."""
    s = site.groupBy("study_id").agg(
        F.count("site_id").alias("site_count"), F.sum("patient_count").alias("patient_count"),
        F.avg("dqi_mean").alias("avg_dqi"), F.avg("tier1_clean_rate").alias("avg_tier1_rate"),
        F.avg("tier2_clean_rate").alias("avg_tier2_rate"), F.avg("ready_rate").alias("avg_ready_rate"),
        F.avg("composite_score").alias("avg_site_score"))
    s = histogram_rank(s, "avg_site_score", ascending=False, prefix="_r")
    s = s.withColumnRenamed("_r_rank_min", "study_rank").drop("_r_rank_avg", "_r_pct")
    s = histogram_rank(s, "avg_site_score", ascending=True, prefix="_p")
    s = s.withColumn("study_percentile", F.col("_p_pct") * 100.0).drop("_p_rank_min", "_p_rank_avg", "_p_pct")
    return s.withColumn("study_tier", band(F.col("study_percentile"), config.STUDY_TIERS_BY_PCTL,
                                           config.STUDY_TIER_FLOOR))


def _pct_text(x):
    return round_half_even(x, 0).cast("long").cast("string")


def narratives(site: DataFrame) -> DataFrame:
    """Rule-based insight text per site, first three joined."""
    c = F.col
    dp = c("dqi_mean_study_pctl")
    rr = c("ready_rate")
    ins = F.array_compact(F.array(
        F.when(c("is_small_site"), F.concat(F.lit("⚠️ Small site ("), c("patient_count").cast("string"),
                                             F.lit(" patients) - scores less reliable"))),
        F.when(dp >= 75, F.concat(F.lit("DQI in top 25% of study (P"), _pct_text(dp), F.lit(")")))
        .when(dp <= 25, F.concat(F.lit("DQI in bottom 25% - needs focus (P"), _pct_text(dp), F.lit(")"))),
        F.when(rr >= 50, F.concat(F.lit("Good DB Lock readiness: "), _pct_text(rr), F.lit("%")))
        .when(rr < 20, F.concat(F.lit("Low readiness: "), _pct_text(rr), F.lit("% - priority"))),
        F.when(c("is_any_outlier"), F.lit("⚠️ Statistical outlier detected")),
    ))
    return site.select("study_id", "site_id", "patient_count", "composite_score", "performance_tier",
                       "overall_rank", "study_rank",
                       F.when(F.size(ins) == 0, "Normal performance")
                       .otherwise(F.array_join(F.slice(ins, 1, 3), "; ")).alias("summary"))
