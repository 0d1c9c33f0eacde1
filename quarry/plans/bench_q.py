"""Benchmark queries."""
from __future__ import annotations

from quarry import config
from quarry.operators import benchmark as B
from quarry.plans import sqlbase as S
from quarry.plans.cache import materialized_plan, shared_plan
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH, enhanced_record
from quarry.plans.core import rec  # noqa: F401


def _f(x):
    return repr(float(x))


@materialized_plan
def site_base(spark, sf):
    return B.site_base(enhanced_record(spark, sf))


@materialized_plan
def site_ranked(spark, sf):
    return B.site_outliers(B.site_rankings(B.peer_benchmarks(site_base(spark, sf))))


_size = " ".join(f"WHEN patient_count >= {lo} AND patient_count <= {hi} THEN '{lab}'" for lo, hi, lab in config.SITE_SIZE_BINS)
SITE_BASE = f"""
, sb_a AS (
  SELECT study_id, site_id, count(*) AS patient_count, avg(dqi_score) AS dqi_mean,
    CAST(sum(total_queries) AS BIGINT) AS total_queries, CAST(sum(crfs_require_verification_sdv) AS BIGINT) AS sdv_pending,
    CAST(sum(crfs_never_signed) AS BIGINT) AS unsigned_crfs, avg(dblock_days_to_ready) AS avg_days_to_ready,
    count(*) FILTER (WHERE tier1_clean) AS tier1_clean_count, count(*) FILTER (WHERE tier2_clean) AS tier2_clean_count,
    count(*) FILTER (WHERE dblock_tier1_ready) AS ready_count, min(region) AS region, min(country) AS country
  FROM elock GROUP BY study_id, site_id),
site_base AS (
  SELECT *, round_even(tier1_clean_count / patient_count * 100.0, 1) AS tier1_clean_rate,
    round_even(tier2_clean_count / patient_count * 100.0, 1) AS tier2_clean_rate,
    round_even(ready_count / patient_count * 100.0, 1) AS ready_rate,
    round_even(total_queries / patient_count, 2) AS queries_per_patient,
    patient_count < {config.MIN_PATIENTS_FULL_SCORE} AS is_small_site, CASE {_size} ELSE 'Unknown' END AS site_size
  FROM sb_a)"""
_SB_COLS = ["study_id", "site_id", "patient_count", "dqi_mean", "total_queries", "sdv_pending", "unsigned_crfs",
            "avg_days_to_ready", "tier1_clean_count", "tier2_clean_count", "ready_count", "region", "country",
            "tier1_clean_rate", "tier2_clean_rate", "ready_rate", "queries_per_patient", "is_small_site", "site_size"]
_SB_D = {"dqi_mean", "avg_days_to_ready", "tier1_clean_rate", "tier2_clean_rate", "ready_rate", "queries_per_patient"}


def _sel(cols, doubles):
    return ", ".join(S.r6(c, c) if c in doubles else c for c in cols)


@query("a17_site_benchmark_base", ENH + SITE_BASE + f" SELECT {_sel(_SB_COLS, _SB_D)} FROM site_base")
def q_a17(spark, sf):
    return finalize(site_base(spark, sf).select(*_SB_COLS))


_peer_cols, _peer_sql = [], []
for _peer, _cols in config.BENCH_PEERS:
    _p = ", ".join(_cols)
    for _m in config.BENCH_METRICS:
        _w = f"OVER (PARTITION BY {_p})"
        _peer_cols += [f"{_m}_{_peer}_{x}" for x in ("mean", "std", "median", "pctl", "vs_mean")]
        _peer_sql += [
            S.r6(f"avg({_m}) {_w}", f"{_m}_{_peer}_mean"), S.r6(f"stddev_samp({_m}) {_w}", f"{_m}_{_peer}_std"),
            S.r6(f"quantile_cont({_m}, 0.5) {_w}", f"{_m}_{_peer}_median"),
            S.r6(f"CASE WHEN {_m} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY {_p} ORDER BY {_m} ASC NULLS LAST) + "
                 f"(count(*) OVER (PARTITION BY {_p}, {_m}) - 1) / 2.0) / count({_m}) {_w} END * 100.0", f"{_m}_{_peer}_pctl"),
            S.r6(f"{_m} - avg({_m}) {_w}", f"{_m}_{_peer}_vs_mean")]


@query("w1_peer_benchmark", ENH + SITE_BASE + f" SELECT study_id, site_id, {', '.join(_peer_sql)} FROM site_base")
def q_w1(spark, sf):
    return finalize(B.peer_benchmarks(site_base(spark, sf)).select("study_id", "site_id", *_peer_cols))


_W = config.COMPOSITE_WEIGHTS
_TW = sum(_W.values())
RANKED = f"""
, sr_a AS (
  SELECT s.*, CASE WHEN dmax > dmin THEN (dqi_mean - dmin) / (dmax - dmin) * 100.0 ELSE 100.0 END AS dqi_norm,
    CASE WHEN qmax > 0 THEN (1.0 - queries_per_patient / qmax) * 100.0 ELSE 100.0 END AS queries_norm,
    CASE WHEN tmax > 0 THEN (1.0 - coalesce(avg_days_to_ready, 0.0) / tmax) * 100.0 ELSE 100.0 END AS days_norm
  FROM site_base s CROSS JOIN (SELECT min(dqi_mean) AS dmin, max(dqi_mean) AS dmax, max(queries_per_patient) AS qmax,
    max(avg_days_to_ready) AS tmax FROM site_base)),
sr_b AS (
  SELECT *, round_even((dqi_norm * {_f(_W['dqi'])} + coalesce(tier2_clean_rate, 0.0) * {_f(_W['tier2'])}
    + coalesce(ready_rate, 0.0) * {_f(_W['ready'])} + coalesce(queries_norm, 0.0) * {_f(_W['queries'])}
    + coalesce(days_norm, 0.0) * {_f(_W['days'])}) / {_f(_TW)}, 1) AS composite_score_raw FROM sr_a),
sr_c AS (
  SELECT *, round_even(composite_score_raw * least(patient_count / {_f(config.MIN_PATIENTS_FULL_SCORE)}, 1.0)
    + (SELECT avg(composite_score_raw) FROM sr_b) * (1.0 - least(patient_count / {_f(config.MIN_PATIENTS_FULL_SCORE)}, 1.0)), 1)
    AS composite_score FROM sr_b),
ranked AS (
  SELECT *, rank() OVER (ORDER BY composite_score DESC) AS overall_rank,
    (rank() OVER (ORDER BY composite_score ASC) + (count(*) OVER (PARTITION BY composite_score) - 1) / 2.0)
      / count(composite_score) OVER () * 100.0 AS composite_percentile,
    rank() OVER (PARTITION BY study_id ORDER BY composite_score DESC) AS study_rank,
    rank() OVER (PARTITION BY region ORDER BY composite_score DESC) AS region_rank
  FROM sr_c),
ranked2 AS (
  SELECT *, CASE {' '.join(f"WHEN composite_percentile >= {t} THEN '{lab}'" for t, lab in config.SITE_TIERS_BY_PCTL)}
    ELSE '{config.SITE_TIER_FLOOR}' END AS performance_tier FROM ranked)"""
_RK = ["study_id", "site_id", "dqi_norm", "queries_norm", "days_norm", "composite_score_raw", "composite_score",
       "overall_rank", "composite_percentile", "study_rank", "region_rank", "performance_tier"]
_RK_D = {"dqi_norm", "queries_norm", "days_norm", "composite_score_raw", "composite_score", "composite_percentile"}


@query("w4_w6_site_rankings", ENH + SITE_BASE + RANKED + f" SELECT {_sel(_RK, _RK_D)} FROM ranked2")
def q_w4(spark, sf):
    return finalize(B.site_rankings(site_base(spark, sf)).select(*_RK))


_ms = config.BENCH_METRICS
OUTL = f"""
, ol_a AS (
  SELECT r.*, {', '.join(f"CASE WHEN sd_{m} > 0 THEN round_even(({m} - mu_{m}) / sd_{m}, 2) END AS {m}_zscore" for m in _ms)}
  FROM ranked2 r CROSS JOIN (SELECT {', '.join(f'avg({m}) AS mu_{m}, stddev_samp({m}) AS sd_{m}' for m in _ms)} FROM ranked2)),
ol_b AS (SELECT *, {', '.join(f'coalesce(abs({m}_zscore) > {_f(config.OUTLIER_Z)}, false) AS {m}_outlier' for m in _ms)} FROM ol_a),
outl AS (SELECT *, ({' + '.join(f'CAST({m}_outlier AS INTEGER)' for m in _ms)}) > 0 AS is_any_outlier,
  CAST({' + '.join(f'CAST({m}_outlier AS INTEGER)' for m in _ms)} AS BIGINT) AS outlier_count FROM ol_b)"""
_OL = ["study_id", "site_id"] + [f"{m}_zscore" for m in _ms] + [f"{m}_outlier" for m in _ms] + ["is_any_outlier",
                                                                                                 "outlier_count"]


@query("w7_site_outliers", ENH + SITE_BASE + RANKED + OUTL + f" SELECT {_sel(_OL, {f'{m}_zscore' for m in _ms})} FROM outl")
def q_w7(spark, sf):
    return finalize(B.site_outliers(B.site_rankings(site_base(spark, sf))).select(*_OL))


def _pvs(m):
    w = "OVER (PARTITION BY study_id, site_id)"
    return [S.r6(f"avg({m}) {w}", f"{m}_site_mean"), S.r6(f"stddev_samp({m}) {w}", f"{m}_site_std"),
            S.r6(f"{m} - avg({m}) {w}", f"{m}_vs_site"),
            S.r6(f"(rank() OVER (PARTITION BY study_id, site_id ORDER BY {m} ASC NULLS LAST) + (count(*) OVER "
                 f"(PARTITION BY study_id, site_id, {m}) - 1) / 2.0) / count({m}) {w} * 100.0", f"{m}_site_pctl")]


_W8 = ["patient_key", "study_id", "site_id"] + [f"{m}_{x}" for m in ("dqi_score", "total_queries")
                                                 for x in ("site_mean", "site_std", "vs_site", "site_pctl")]


@query("w8_patient_vs_site", ENH + f" SELECT patient_key, study_id, site_id, {', '.join(_pvs('dqi_score') + _pvs('total_queries'))} FROM elock")
def q_w8(spark, sf):
    return finalize(B.patient_vs_site(enhanced_record(spark, sf)).select(*_W8))


@query("a18_study_benchmarks", ENH + SITE_BASE + RANKED + f"""
, st AS (
  SELECT study_id, count(site_id) AS site_count, CAST(sum(patient_count) AS BIGINT) AS patient_count, avg(dqi_mean) AS avg_dqi,
    avg(tier1_clean_rate) AS avg_tier1_rate, avg(tier2_clean_rate) AS avg_tier2_rate, avg(ready_rate) AS avg_ready_rate,
    avg(composite_score) AS avg_site_score
  FROM ranked2 GROUP BY study_id),
st2 AS (
  SELECT *, rank() OVER (ORDER BY avg_site_score DESC) AS study_rank,
    (rank() OVER (ORDER BY avg_site_score ASC) + (count(*) OVER (PARTITION BY avg_site_score) - 1) / 2.0)
      / count(avg_site_score) OVER () * 100.0 AS study_percentile
  FROM st)
SELECT study_id, site_count, patient_count, round(avg_dqi, 6) AS avg_dqi, round(avg_tier1_rate, 6) AS avg_tier1_rate,
  round(avg_tier2_rate, 6) AS avg_tier2_rate, round(avg_ready_rate, 6) AS avg_ready_rate,
  round(avg_site_score, 6) AS avg_site_score, study_rank, round(study_percentile, 6) AS study_percentile,
  CASE {' '.join(f"WHEN study_percentile >= {t} THEN '{lab}'" for t, lab in config.STUDY_TIERS_BY_PCTL)}
    ELSE '{config.STUDY_TIER_FLOOR}' END AS study_tier
FROM st2""")
def q_a18(spark, sf):
    return finalize(B.study_benchmarks(B.site_rankings(site_base(spark, sf))))


def _pt(x):
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


_dp = ("(CASE WHEN dqi_mean IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY study_id ORDER BY dqi_mean ASC NULLS LAST) "
       "+ (count(*) OVER (PARTITION BY study_id, dqi_mean) - 1) / 2.0) / count(dqi_mean) OVER (PARTITION BY study_id) "
       "* 100.0 END)")


@query("d23_benchmark_narratives", ENH + SITE_BASE + RANKED + OUTL + f"""
, nv AS (SELECT *, {_dp} AS dp FROM outl),
nv2 AS (
  SELECT *, list_filter([
    CASE WHEN is_small_site THEN '⚠️ Small site (' || CAST(patient_count AS VARCHAR) || ' patients) - scores less reliable' END,
    CASE WHEN dp >= 75 THEN 'DQI in top 25% of study (P' || {_pt('dp')} || ')'
         WHEN dp <= 25 THEN 'DQI in bottom 25% - needs focus (P' || {_pt('dp')} || ')' END,
    CASE WHEN ready_rate >= 50 THEN 'Good DB Lock readiness: ' || {_pt('ready_rate')} || '%'
         WHEN ready_rate < 20 THEN 'Low readiness: ' || {_pt('ready_rate')} || '% - priority' END,
    CASE WHEN is_any_outlier THEN '⚠️ Statistical outlier detected' END], lambda x: x IS NOT NULL) AS ins
  FROM nv)
SELECT study_id, site_id, patient_count, round(composite_score, 6) AS composite_score, performance_tier, overall_rank,
  study_rank, CASE WHEN len(ins) = 0 THEN 'Normal performance' ELSE array_to_string(list_slice(ins, 1, 3), '; ') END AS summary
FROM nv2""")
def q_d23(spark, sf):
    return finalize(B.narratives(site_ranked(spark, sf)))
