"""Baseline ranker (M13), cross-study report (A60), multi-collection search (V7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import ml as ML, patterns as PT, vector as VX
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.patterns_q import MATCH_SQL, site_patterns
from quarry.plans.registry import finalize, query
from quarry.plans.scores_q import ENH, enhanced_record
from quarry.plans.text_q import _VEC_SQL
from quarry.sources.tables import load


def _site(spark, sf):
    i = issue_record(spark, sf).groupBy("study_id", "site_id").agg(
        F.count(F.lit(1)).alias("patients"), F.sum("total_issues").alias("issues"),
        F.sum(F.col("count_signature_gaps") + F.col("count_broken_signatures")).alias("sig"),
        F.sum(F.col("count_sae_dm_pending") + F.col("count_sae_safety_pending")).alias("sae"))
    e = enhanced_record(spark, sf).groupBy("study_id", "site_id").agg(F.avg("dqi_sdv_raw").alias("sdv_completion_rate"))
    x = i.join(e, ["study_id", "site_id"])
    return x.select("study_id", "site_id", (F.col("issues") / F.col("patients")).alias("issue_density"),
                    (F.col("sig") / F.col("patients")).alias("signature_backlog_rate"),
                    (F.col("sae") > 0).cast("int").alias("has_sae_pending"), "sdv_completion_rate")


def _mm(c):
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


@query("m13_baseline_ranker", ENH + "," + ISSUES + f""",
i AS (SELECT study_id, site_id, count(*) AS patients, sum(total_issues) AS issues,
  sum(count_signature_gaps + count_broken_signatures) AS sig, sum(count_sae_dm_pending + count_sae_safety_pending) AS sae
  FROM iss GROUP BY ALL),
e AS (SELECT study_id, site_id, avg(r_sdv) AS sdv_completion_rate FROM elock GROUP BY ALL),
x AS (SELECT study_id, site_id, issues / patients AS issue_density, sig / patients AS signature_backlog_rate,
  CAST(sae > 0 AS INTEGER) AS has_sae_pending, sdv_completion_rate, 100.0 - coalesce(sdv_completion_rate, 100.0) AS inverse_sdv
  FROM i JOIN e USING (study_id, site_id)),
y AS (SELECT *, 0.3 * ({_mm('issue_density')}) + 0.25 * ({_mm('signature_backlog_rate')}) + 0.25 * CAST(has_sae_pending AS DOUBLE)
  + 0.2 * ({_mm('inverse_sdv')}) AS baseline_score FROM x)
SELECT study_id, site_id, round(issue_density, 6) AS issue_density, round(signature_backlog_rate, 6) AS signature_backlog_rate,
  CAST(has_sae_pending AS BIGINT) AS has_sae_pending, round(sdv_completion_rate, 6) AS sdv_completion_rate,
  round(baseline_score, 6) AS baseline_score, rank() OVER (ORDER BY baseline_score DESC) AS risk_rank FROM y""")
def q_m13(spark, sf):
    return finalize(ML.baseline_ranker(_site(spark, sf)))


@query("a60_cross_study_report", MATCH_SQL + """
SELECT category, study_id, count(*) AS matches, count(DISTINCT entity_id) AS sites, round(avg(confidence), 6) AS avg_confidence
FROM matches GROUP BY ALL""")
def q_a60(spark, sf):
    return finalize(PT.cross_study_report(site_patterns(spark, sf)))


@query("v7_multi_collection_search", "WITH " + _VEC_SQL + f""",
c AS (SELECT *, 'collection_' || CAST(label % 3 AS VARCHAR) AS collection FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id ASC) AS rank FROM c),
t AS (SELECT * FROM k WHERE rank <= {config.TOP_K}),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC) AS merged_rank FROM t)
SELECT query_id, collection, vec_id, round(score, 6) AS score, rank, merged_rank FROM m WHERE merged_rank <= 8""")
def q_v7(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("collection", F.concat(F.lit("collection_"), (F.col("label") % 3).cast("string")))
    hits = VX.cosine_topk(e, VX.label_centroids(e), group="collection")
    return finalize(VX.merged_top(hits, 8).select("query_id", "collection", "vec_id", "score", "rank", "merged_rank"))
