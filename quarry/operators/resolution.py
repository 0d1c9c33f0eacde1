"""Resolution assignment.

The template table is a fixed rule table (broadcast: its size is set by
code).  Issue ranks are per patient (at most 14 rows per window)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import config


def templates(spark: SparkSession) -> DataFrame:
    rows = [(t, it, title, role, eff, 0.0, i) for i, (t, it, title, role, eff) in enumerate(config.RESOLUTION_TEMPLATES)]
    return spark.createDataFrame(rows, "template_id string, issue_type string, title string, responsible_role string, "
                                       "estimated_effort_hours double, success_rate double, ordinal int")


def best_templates(spark: SparkSession) -> DataFrame:
    """Per issue type the template with the highest success rate, then
    the lowest effort, then the first declared."""
    w = Window.partitionBy("issue_type").orderBy(F.col("success_rate").desc(), F.col("estimated_effort_hours").asc(),
                                                 F.col("ordinal").asc())
    return templates(spark).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "ordinal")


def recommendations(issue_rows: DataFrame) -> DataFrame:
    """W9 + D30 + D36: each patient's issues ranked by the fixed priority
    order; rank 1 is the primary issue; best template attached (generic
    fallback when none); confidence .85 primary, .75 others, .5 generic."""
    spark = issue_rows.sparkSession
    prio = F.create_map(*[x for i, t in enumerate(config.ISSUE_PRIORITY_ORDER) for x in (F.lit(t), F.lit(i + 1))])
    x = issue_rows.withColumn("priority", F.coalesce(prio[F.col("issue_type")], F.lit(99)))
    w = Window.partitionBy("patient_key").orderBy("priority", "issue_type")
    x = x.withColumn("issue_rank", F.row_number().over(w))
    bt = F.broadcast(best_templates(spark).select("issue_type", "template_id", F.col("title").alias("recommended_action"),
                                                  F.col("responsible_role").alias("t_role"), "estimated_effort_hours"))
    x = x.join(bt, "issue_type", "left")
    generic = F.col("template_id").isNull()
    return x.select(
        "patient_key", "study_id", "site_id", "issue_rank", "issue_type", "issue_count",
        (F.col("issue_rank") == 1).alias("is_primary_issue"),
        F.coalesce("template_id", F.lit("GENERIC-001")).alias("template_id"),
        F.when(generic, F.concat(F.lit("Resolve "), F.regexp_replace("issue_type", "_", " "), F.lit(" issue")))
        .otherwise(F.col("recommended_action")).alias("recommended_action"),
        F.when(generic, "Data Manager").otherwise(F.col("t_role")).alias("responsible_role"),
        F.when(generic, 0.5).otherwise(F.col("estimated_effort_hours")).alias("estimated_effort_hours"),
        F.when(generic, 0.5).when(F.col("issue_rank") == 1, 0.85).otherwise(0.75).alias("confidence"))


def role_queue(recs: DataFrame) -> DataFrame:
    """Tasks and effort per responsible role."""
    g = recs.groupBy("responsible_role").agg(F.count(F.lit(1)).alias("task_count"),
                                             F.sum("estimated_effort_hours").alias("total_effort_hours"))
    return g.withColumn("avg_effort_per_task", F.col("total_effort_hours") / F.col("task_count"))


def issue_summary(recs: DataFrame) -> DataFrame:
    """Per issue type: distinct patients, template, role, mean effort and
    confidence."""
    return recs.groupBy("issue_type").agg(
        F.count_distinct("patient_key").alias("patient_count"), F.min("template_id").alias("primary_template_id"),
        F.min("responsible_role").alias("responsible_role"), F.avg("estimated_effort_hours").alias("avg_effort_hours"),
        F.avg("confidence").alias("avg_confidence"))
