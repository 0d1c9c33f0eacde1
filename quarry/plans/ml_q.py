"""Feature, evaluation and model queries (M1, M4, M8, M14, M16, M18, M20,
M22, M23, M25, M28, M29, X7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import anomaly as AN
from quarry.operators import issues as IS
from quarry.operators import ml as ML
from quarry.operators import neighbors as NB
from quarry.operators.segment import segment_risk
from quarry.plans import sqlbase as S
from quarry.plans.bench_q import RANKED, SITE_BASE, site_ranked
from quarry.plans.cache import shared_plan
from quarry.plans.core import rec
from quarry.plans.gov_q import PRED_SQL
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH
from quarry.session import materialize_table
from quarry.sources import testmap

FEATURES = ["visit_missing_visit_count", "pages_missing_page_count", "total_queries", "crfs_require_verification_sdv",
            "crfs_never_signed", "meddra_coding_meddra_uncoded", "whodrug_coding_whodrug_uncoded", "lab_lab_issue_count",
            "edrr_edrr_issue_count", "inactivated_inactivated_form_count", "broken_signatures"]
SCALE = ["visit_visits_overdue_avg_days", "pages_pages_missing_avg_days", "total_queries"]
RISK_ORDER = ["Low", "Medium", "High", "Critical"]


@query("m1_variance_screen", S.with_record() + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_samp(CAST({c} AS DOUBLE)), 6) AS variance, count(DISTINCT {c}) AS distinct_values, "
    f"count(DISTINCT {c}) <= 1 OR coalesce(var_samp(CAST({c} AS DOUBLE)), 0.0) < 0.01 AS drop FROM record" for c in FEATURES))
def q_m1(spark, sf):
    return finalize(ML.variance_screen(rec(spark, sf), FEATURES))


def _rs(c):
    q = f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) OVER ()"
    return (f"round((CAST({c} AS DOUBLE) - ({q})[2]) / CASE WHEN ({q})[3] - ({q})[1] = 0 THEN 1.0 ELSE ({q})[3] - ({q})[1] END, 6)"
            f" AS {c}_scaled")


@query("m4_robust_scale", S.with_record() + f"SELECT patient_key, {', '.join(_rs(c) for c in SCALE)} FROM record")
def q_m4(spark, sf):
    return finalize(ML.robust_scale(rec(spark, sf), ["patient_key"], SCALE))


_PRED = ("CASE WHEN total_issues_all_sources >= 10 THEN 'Critical' WHEN total_issues_all_sources >= 5 THEN 'High' "
         "WHEN total_issues_all_sources >= 1 THEN 'Medium' ELSE 'Low' END")
_CR = f"""
, lp AS (SELECT risk_level AS actual, {_PRED} AS predicted FROM record),
cm AS (SELECT actual, predicted, count(*) AS n FROM lp GROUP BY ALL),
cls AS (SELECT actual AS cls FROM cm UNION SELECT predicted FROM cm),
r0 AS (SELECT c.cls, coalesce((SELECT sum(n) FROM cm WHERE actual = c.cls), 0) AS support,
  coalesce((SELECT sum(n) FROM cm WHERE predicted = c.cls), 0) AS pred, coalesce((SELECT sum(n) FROM cm WHERE actual = c.cls AND predicted = c.cls), 0) AS tp
  FROM cls c),
r1 AS (SELECT cls, CAST(support AS BIGINT) AS support, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM r0),
r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r1)"""


@query("m16_class_report", S.with_record() + _CR + """
SELECT cls, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r
UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM r
UNION ALL SELECT 'weighted avg', CAST(sum(support) AS BIGINT), round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM r""")
def q_m16(spark, sf):
    r = rec(spark, sf).withColumn("predicted", segment_risk(F.col("total_issues_all_sources")))
    return finalize(ML.class_report(r, "risk_level", "predicted"))


_POS = "CASE {c} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(RISK_ORDER)) + " END"


@query("m25_ordinal_errors", S.with_record() + f"""
, lp AS (SELECT risk_level AS a, {_PRED} AS p FROM record)
SELECT round(avg(abs(({_POS.format(c='p')}) - ({_POS.format(c='a')}))), 6) AS ordinal_mae,
  round(avg(CASE WHEN a = 'Critical' THEN CAST(p <> 'Critical' AS DOUBLE) END), 6) AS critical_miss_rate,
  round(avg(CASE WHEN ({_POS.format(c='p')}) - ({_POS.format(c='a')}) < 0 THEN -(({_POS.format(c='p')}) - ({_POS.format(c='a')})) * 2.0
    ELSE CAST(({_POS.format(c='p')}) - ({_POS.format(c='a')}) AS DOUBLE) END), 6) AS cost_weighted_error,
  round(avg(CAST(a = p AS DOUBLE)), 6) AS accuracy
FROM lp""")
def q_m25(spark, sf):
    r = rec(spark, sf).withColumn("predicted", segment_risk(F.col("total_issues_all_sources")))
    return finalize(ML.ordinal_errors(r, "risk_level", "predicted", RISK_ORDER, "Critical"))


@query("m20_class_balance", S.with_record() + """
SELECT risk_level AS cls, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS prevalence,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS class_weight FROM record GROUP BY risk_level""")
def q_m20(spark, sf):
    return finalize(ML.class_balance(rec(spark, sf), "risk_level"))


@query("m18_best_f1_threshold", "WITH " + PRED_SQL + """,
h AS (SELECT confidence AS t, count(*) AS n, sum(CAST(outcome_type = 'accepted' AS BIGINT)) AS pos FROM dec GROUP BY 1),
c AS (SELECT t, sum(n) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS pp, sum(pos) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS tp,
  (SELECT sum(pos) FROM h) AS P FROM h),
m AS (SELECT t, tp / pp AS precision, CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT round(t, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM f ORDER BY f1 DESC, t ASC LIMIT 1""")
def q_m18(spark, sf):
    p = testmap.predictions(spark, sf).filter(F.col("outcome_type").isin("accepted", "modified", "rejected", "auto_executed"))
    return finalize(ML.best_f1_threshold(p, "confidence", F.col("outcome_type") == "accepted"))


def _ndcg(k):
    return f"""
tp{k} AS (SELECT dqi_mean / log2(row_number() OVER (ORDER BY composite_score DESC, item ASC) + 1.0) AS g
  FROM (SELECT * FROM it ORDER BY composite_score DESC, item ASC LIMIT {k})),
tt{k} AS (SELECT dqi_mean / log2(row_number() OVER (ORDER BY dqi_mean DESC, item ASC) + 1.0) AS g
  FROM (SELECT * FROM it ORDER BY dqi_mean DESC, item ASC LIMIT {k}))"""


M14_SQL = ENH + SITE_BASE + RANKED + f"""
, it AS (SELECT study_id || '|' || site_id AS item, composite_score, dqi_mean FROM ranked2),
rk AS (SELECT (rank() OVER (ORDER BY composite_score) + (count(*) OVER (PARTITION BY composite_score) - 1) / 2.0) AS rp,
  (rank() OVER (ORDER BY dqi_mean) + (count(*) OVER (PARTITION BY dqi_mean) - 1) / 2.0) AS rt FROM it),
{','.join(_ndcg(k) for k in (5, 10, 20))}
SELECT round((SELECT corr(rp, rt) FROM rk), 6) AS spearman,
  {', '.join(f"round(CASE WHEN (SELECT sum(g) FROM tt{k}) > 0 THEN (SELECT sum(g) FROM tp{k}) / (SELECT sum(g) FROM tt{k}) ELSE 0.0 END, 6) AS ndcg_at_{k}" for k in (5, 10, 20))}"""


@query("m14_ranking_metrics", M14_SQL)
def q_m14(spark, sf):
    s = site_ranked(spark, sf).select(F.concat_ws("|", "study_id", "site_id").alias("item"), "composite_score", "dqi_mean")
    return finalize(ML.ranking_metrics(s, "item", "composite_score", "dqi_mean"))


Z = ["visit_missing_visit_count", "pages_missing_page_count", "total_queries", "crfs_require_verification_sdv",
     "crfs_never_signed"]
_zs = {c: f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END" for c in Z}


@query("m23_zscore_drivers", S.with_record() + f"""
, st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in Z)} FROM record),
z AS (SELECT patient_key, {', '.join(f'{_zs[c]} AS z_{c}' for c in Z)} FROM record, st)
SELECT patient_key, round(greatest({', '.join(f'z_{c}' for c in Z)}), 6) AS max_z,
  array_to_string(list_transform(list_slice(list_filter(list_sort([{', '.join(f"{{'k': -z_{c}, 'o': {i}, 'n': '{c}', 'z': z_{c}}}" for i, c in enumerate(Z))}]),
    lambda s: s.z > 2.0), 1, 3), lambda s: s.n || ' (z=' || printf('%.2f', s.z) || ')'), ', ') AS top_drivers
FROM z""")
def q_m23(spark, sf):
    return finalize(ML.zscore_drivers(rec(spark, sf), ["patient_key"], Z))


@query("m28_context_features", S.with_record() + """
, site AS (SELECT study_id, site_id, count(*) AS site_patients FROM record GROUP BY ALL),
study AS (SELECT study_id, avg(pages_missing_page_count) AS m, stddev_samp(pages_missing_page_count) AS s FROM record GROUP BY 1),
q AS (SELECT quantile_cont(site_patients, [0.25, 0.75]) AS q FROM site)
SELECT r.patient_key, site.site_patients, round(study.m, 6) AS study_pages_mean, round(study.s, 6) AS study_pages_std,
  round(CASE WHEN study.m > 0 THEN r.pages_missing_page_count / study.m ELSE 0.0 END, 6) AS pages_ratio_to_study,
  site.site_patients >= q.q[2] AS large_site, site.site_patients <= q.q[1] AS small_site
FROM record r JOIN site USING (study_id, site_id) JOIN study USING (study_id) CROSS JOIN q""")
def q_m28(spark, sf):
    return finalize(ML.context_features(rec(spark, sf)))


@query("m29_low_prevalence", S.with_record(ISSUES) + " UNION ALL ".join(
    f"SELECT '{t}' AS issue_type, CAST(sum(issue_{t}) AS BIGINT) AS positives, round(sum(issue_{t}) / count(*), 6) AS prevalence, "
    f"sum(issue_{t}) / count(*) < 0.01 AS below_threshold FROM iss" for t in IS.TYPES))
def q_m29(spark, sf):
    return finalize(ML.low_prevalence(issue_record(spark, sf), IS.TYPES))


@query("x7_stratified_split", S.with_record() + """
, o AS (SELECT patient_key, risk_level, row_number() OVER (PARTITION BY risk_level ORDER BY md5(patient_key)) AS rn,
  count(*) OVER (PARTITION BY risk_level) AS n FROM record)
SELECT patient_key, risk_level, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'validation'
  ELSE 'test' END AS split FROM o""")
def q_x7(spark, sf):
    r = rec(spark, sf).select("patient_key", "risk_level")
    return finalize(ML.stratified_split(r, "risk_level", F.md5(F.col("patient_key"))))


@query("m22_anomaly_scores")
def q_m22(spark, sf):
    return finalize(AN.anomaly_lite(rec(spark, sf), "patient_key", ["study_id", "site_id"], FEATURES))


_RT = " + ".join(
    f"CASE WHEN {({'sae_dm_pending_calc': 'greatest(sae_dm_sae_dm_total - sae_dm_sae_dm_completed, 0)', 'sae_safety_pending_calc': 'greatest(sae_safety_sae_safety_total - sae_safety_sae_safety_completed, 0)', 'meddra_uncoded_calc': 'greatest(meddra_coding_meddra_total - meddra_coding_meddra_coded, 0)'}).get(c, f'coalesce({c}, 0)')} > {t} THEN {p!r} ELSE 0.0 END"
    for c, t, p in __import__('quarry.config', fromlist=['x']).RISK_TARGET_TERMS)


@shared_plan
def anomalies(spark, sf):
    """The patients' ensemble scores, made once for the queries that read them."""
    return materialize_table(AN.anomaly_ensemble(rec(spark, sf), "patient_key", ["study_id", "site_id"], FEATURES), "anomalies")


@query("m21_anomaly_ensemble")
def q_m21(spark, sf):
    return finalize(anomalies(spark, sf))


@query("a19_a20_w11_site_anomalies")
def q_a19(spark, sf):
    return finalize(AN.site_anomalies(anomalies(spark, sf)))


_dist = "sqrt(" + " + ".join(f"(CAST(p.{c} AS DOUBLE) - q.{c}) * (CAST(p.{c} AS DOUBLE) - q.{c})" for c in FEATURES) + ")"


@query("x8_nearest_patients", S.with_record() + f"""
, nn AS (SELECT p.patient_key, q.patient_key AS other, {_dist} AS d, row_number() OVER (PARTITION BY p.patient_key ORDER BY {_dist}, q.patient_key) AS n
  FROM record p JOIN record q ON p.patient_key <> q.patient_key)
SELECT patient_key, string_agg(other, ',' ORDER BY n) AS nearest, round(max(d), 6) AS radius FROM nn WHERE n <= 3 GROUP BY 1""")
def q_x8_near(spark, sf):
    """The three nearest other patients of every patient."""
    near = NB.nearest_rows(rec(spark, sf), "patient_key", FEATURES, 3)
    return finalize(near.select(F.col("id").alias("patient_key"), F.array_join(F.transform("near", lambda n: n["id"]), ",").alias("nearest"), F.element_at("near", -1)["d"].alias("radius")))


@query("x8_smote")
def q_x8_smote(spark, sf):
    return finalize(NB.smote(rec(spark, sf), "patient_key", "risk_level", FEATURES))


@query("m5_risk_target", S.with_record() + f"""
, s AS (SELECT patient_key, 0.0 + {_RT} AS risk_score FROM record),
q AS (SELECT quantile_cont(risk_score, 0.5) AS p50, quantile_cont(risk_score, 0.8) AS p80, quantile_cont(risk_score, 0.95) AS p95 FROM s)
SELECT patient_key, round(risk_score, 6) AS risk_score, CASE WHEN risk_score <= p50 THEN 'Low' WHEN risk_score <= p80 THEN 'Medium'
  WHEN risk_score <= p95 THEN 'High' ELSE 'Critical' END AS risk_target FROM s, q""")
def q_m5(spark, sf):
    return finalize(ML.risk_target(rec(spark, sf)).select("patient_key", "risk_score", "risk_target"))


@query("o13_anomaly_list")
def q_o13(spark, sf):
    a = AN.anomaly_lite(rec(spark, sf), "patient_key", ["study_id", "site_id"], FEATURES)
    x = a.filter(F.col("is_anomaly") | F.col("severity").isin("Critical", "High"))
    return finalize(x.orderBy(F.col("anomaly_score").desc(), "patient_key").limit(25))


from quarry import config as _cfg  # noqa: E402


@query("m15_red_flags", M14_SQL.replace("\nSELECT round((SELECT corr(rp, rt) FROM rk), 6) AS spearman,", ", mt AS (SELECT round((SELECT corr(rp, rt) FROM rk), 6) AS spearman,", 1) + f""")
SELECT 'LEAKAGE' AS type, 'CRITICAL' AS severity, 'ndcg@5' AS metric, ndcg_at_5 AS value, {_cfg.MAX_ACCEPTABLE_NDCG!r} AS threshold FROM mt WHERE ndcg_at_5 > {_cfg.MAX_ACCEPTABLE_NDCG}
UNION ALL SELECT 'LEAKAGE', 'CRITICAL', 'ndcg@10', ndcg_at_10, {_cfg.MAX_ACCEPTABLE_NDCG!r} FROM mt WHERE ndcg_at_10 > {_cfg.MAX_ACCEPTABLE_NDCG}
UNION ALL SELECT 'LEAKAGE', 'CRITICAL', 'ndcg@20', ndcg_at_20, {_cfg.MAX_ACCEPTABLE_NDCG!r} FROM mt WHERE ndcg_at_20 > {_cfg.MAX_ACCEPTABLE_NDCG}
UNION ALL SELECT 'NOT_LEARNING', 'WARNING', 'ndcg@10', ndcg_at_10, {_cfg.MIN_ACCEPTABLE_NDCG!r} FROM mt WHERE ndcg_at_10 < {_cfg.MIN_ACCEPTABLE_NDCG}""")
def q_m15(spark, sf):
    s = site_ranked(spark, sf).select(F.concat_ws("|", "study_id", "site_id").alias("item"), "composite_score", "dqi_mean")
    return finalize(ML.red_flags(ML.ranking_metrics(s, "item", "composite_score", "dqi_mean")))
