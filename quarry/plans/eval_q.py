"""Ranking agreement, ROC areas and recall-bound thresholds."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluation as EV
from quarry.operators import ml as ML
from quarry.plans import sqlbase as S
from quarry.plans.bench_q import RANKED, SITE_BASE, site_ranked
from quarry.plans.core import rec
from quarry.plans.gov_q import PRED_SQL
from quarry.plans.ml_q import _RT
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH
from quarry.sources import testmap


def _tau_sql(points: str) -> str:
    """Kendall's tau-b by the plain comparison of every pair of points (a, b, c)."""
    return f"""
SELECT pairs, tied_a, tied_b, tied_both, concordant, discordant,
  (concordant - discordant) / (sqrt(CAST(pairs - tied_a AS DOUBLE)) * sqrt(CAST(pairs - tied_b AS DOUBLE))) AS kendall_tau
FROM (SELECT CAST(n * (n - 1) // 2 AS BIGINT) AS pairs FROM (SELECT sum(c) AS n FROM {points})),
  (SELECT CAST(sum(c * (c - 1) // 2) AS BIGINT) AS tied_both FROM {points}),
  (SELECT CAST(sum(c * (c - 1) // 2) AS BIGINT) AS tied_a FROM (SELECT sum(c) AS c FROM {points} GROUP BY a)),
  (SELECT CAST(sum(c * (c - 1) // 2) AS BIGINT) AS tied_b FROM (SELECT sum(c) AS c FROM {points} GROUP BY b)),
  (SELECT CAST(coalesce(sum(p.c * q.c) FILTER (WHERE p.b < q.b), 0) AS BIGINT) AS concordant, CAST(coalesce(sum(p.c * q.c) FILTER (WHERE p.b > q.b), 0) AS BIGINT) AS discordant
   FROM {points} p JOIN {points} q ON p.a < q.a)"""


@query("m14_kendall_tau", S.with_record() + f"""
, pt AS (SELECT CAST(0.0 + {_RT} AS DOUBLE) AS a, CAST(total_issues_all_sources AS DOUBLE) AS b, count(*) AS c FROM record GROUP BY ALL)
SELECT pairs, tied_a, tied_b, tied_both, concordant, discordant, round(kendall_tau, 6) AS kendall_tau FROM ({_tau_sql('pt')})""")
def q_kendall(spark, sf):
    """Agreement of the outcome-based risk score with the number of issues, over all patients."""
    return finalize(EV.kendall_tau(ML.risk_target(rec(spark, sf)), "risk_score", "total_issues_all_sources"))


@query("m14_kendall_lines", f"""
WITH pt AS (SELECT CAST(l_quantity AS DOUBLE) AS a, round(l_discount * 100 + l_tax, 2) AS b, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT pairs, tied_a, tied_b, tied_both, concordant, discordant, round(kendall_tau, 6) AS kendall_tau FROM ({_tau_sql('pt')})""")
def q_kendall_lines(spark, sf):
    """The same over the rows of a fact table: billions of pairs, never formed."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", F.round(F.col("l_discount") * 100 + F.col("l_tax"), 2).alias("rate"))
    return finalize(EV.kendall_tau(li, "l_quantity", "rate"))


@query("m14_rank_agreement", ENH + SITE_BASE + RANKED + f"""
, it AS (SELECT study_id || '|' || site_id AS item, composite_score AS pred, dqi_mean AS truth, CAST(patient_count AS DOUBLE) AS base FROM ranked2),
ta AS (SELECT truth AS a, pred AS b, count(*) AS c FROM it GROUP BY ALL), tb AS (SELECT truth AS a, base AS b, count(*) AS c FROM it GROUP BY ALL),
cut AS (SELECT quantile_cont(truth, 0.75) AS q FROM it),
rk AS (SELECT truth >= q AS hit, row_number() OVER (ORDER BY pred DESC, item) AS place FROM it, cut),
pr AS (SELECT row_number() OVER (ORDER BY place) / place AS precision FROM rk WHERE hit)
SELECT count(*) AS relevant, round(avg(precision), 6) AS map, round(any_value(x.kendall_tau), 6) AS kendall_tau, round(any_value(y.kendall_tau), 6) AS baseline_tau,
  round(any_value(x.kendall_tau) - any_value(y.kendall_tau), 6) AS lift_over_baseline
FROM pr, ({_tau_sql('ta')}) x, ({_tau_sql('tb')}) y""")
def q_agreement(spark, sf):
    s = site_ranked(spark, sf).select(F.concat_ws("|", "study_id", "site_id").alias("item"), "composite_score", "dqi_mean", F.col("patient_count").cast("double").alias("size"))
    return finalize(EV.rank_agreement(s, "item", "composite_score", "dqi_mean", "size"))


OUTCOMES = ["accepted", "modified", "rejected"]
#: Least recall of each outcome's threshold, and the order in which a cascade asks.
TARGETS = {"rejected": 0.8, "modified": 0.6}
_auc = " UNION ALL ".join(
    f"SELECT '{k}' AS class, count(*) FILTER (WHERE y = '{k}') AS positives, "
    f"CASE WHEN count(*) FILTER (WHERE y = '{k}') > 0 AND count(*) FILTER (WHERE y <> '{k}') > 0 THEN (sum(r) FILTER (WHERE y = '{k}') "
    f"- count(*) FILTER (WHERE y = '{k}') * (count(*) FILTER (WHERE y = '{k}') + 1) / 2.0) / (count(*) FILTER (WHERE y = '{k}') * count(*) FILTER (WHERE y <> '{k}')) END AS roc_auc FROM ra"
    for k in OUTCOMES)


@query("m16_roc_auc", "WITH " + PRED_SQL + f""",
ra AS (SELECT outcome_type AS y, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS r FROM dec),
au AS ({_auc})
SELECT class, positives, round(roc_auc, 6) AS roc_auc FROM au
UNION ALL SELECT 'weighted', CAST(coalesce(sum(positives), 0) AS BIGINT), round(sum(roc_auc * positives) / sum(positives), 6) FROM au WHERE roc_auc IS NOT NULL""")
def q_auc(spark, sf):
    p = testmap.predictions(spark, sf).filter(F.col("outcome_type").isin("accepted", "modified", "rejected", "auto_executed"))
    return finalize(EV.roc_auc(p, "confidence", {k: F.col("outcome_type") == k for k in OUTCOMES}))


def _score(k: str) -> str:
    return "round(1.0 - confidence, 3)" if k == "rejected" else "confidence"


def _bound_sql(k: str) -> str:
    return f"""(WITH h AS (SELECT {_score(k)} AS t, count(*) AS n, count(*) FILTER (WHERE outcome_type = '{k}') AS pos FROM dec GROUP BY 1),
 c AS (SELECT t, sum(n) OVER (ORDER BY t DESC) AS pp, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(pos) OVER () AS P FROM h),
 m AS (SELECT t, tp / pp AS precision, CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall FROM c),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
 SELECT '{k}' AS class, t AS threshold, precision, recall, f1 FROM f WHERE recall >= {TARGETS[k]} ORDER BY f1 DESC, t LIMIT 1)"""


@query("m18_recall_bound_thresholds", "WITH " + PRED_SQL + " SELECT class, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ("
       + " UNION ALL ".join(f"SELECT * FROM {_bound_sql(k)}" for k in TARGETS) + ")")
def q_bound(spark, sf):
    p = _decided(spark, sf)
    out = [ML.best_f1_threshold(p, f"score_{k}", F.col("outcome_type") == k, r).select(F.lit(k).alias("class"), "threshold", "precision", "recall", "f1") for k, r in TARGETS.items()]
    return finalize(out[0].unionByName(out[1]))


def _decided(spark, sf):
    p = testmap.predictions(spark, sf).filter(F.col("outcome_type").isin("accepted", "modified", "rejected", "auto_executed"))
    return p.withColumns({f"score_{k}": F.round(1.0 - F.col("confidence"), 3) if k == "rejected" else F.col("confidence") for k in TARGETS})


@query("m18_cascade_decisions", "WITH " + PRED_SQL + ", " + ", ".join(f"t_{k} AS (SELECT threshold AS t FROM {_bound_sql(k)})" for k in TARGETS) + f""",
x AS (SELECT outcome_type, CASE {' '.join(f"WHEN {_score(k)} >= (SELECT t FROM t_{k}) THEN '{k}'" for k in TARGETS)} ELSE 'accepted' END AS decided FROM dec)
SELECT outcome_type AS actual, decided, count(*) AS count FROM x GROUP BY ALL""")
def q_cascade(spark, sf):
    p = _decided(spark, sf)
    decided = F.lit("accepted")
    for k, r in reversed(TARGETS.items()):
        one = ML.best_f1_threshold(p, f"score_{k}", F.col("outcome_type") == k, r).agg(F.max("threshold").alias(f"t_{k}"))
        p = p.crossJoin(F.broadcast(one))
        decided = F.when(F.col(f"score_{k}") >= F.col(f"t_{k}"), k).otherwise(decided)
    return finalize(p.groupBy(F.col("outcome_type").alias("actual"), decided.alias("decided")).agg(F.count("*").alias("count")))
