"""Operational statistics over event logs (A45, A47, A48) and digest
findings (D43)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config


def error_log(events: DataFrame) -> DataFrame:
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    sev = F.when(k < 10, "critical").when(k < 30, "high").when(k < 70, "medium").otherwise("low")
    return events.filter(F.col("event_type") == "error").select(
        "event_id", "ts", sev.alias("severity"), F.concat(F.lit("component_"), (F.col("user_id") % 10).cast("string"))
        .alias("component"), (F.col("value") >= 100).alias("resolved"))


def error_summary(errors: DataFrame) -> DataFrame:
    """Errors and unresolved errors by severity and by component."""
    x = errors.select(F.explode(F.array(F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
                                        F.struct(F.lit("component").alias("dimension"), F.col("component").alias("value"))))
                      .alias("d"), "resolved")
    return x.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("errors"),
                                                   F.count(F.when(~F.col("resolved"), 1)).alias("unresolved"))


def slow_queries(events: DataFrame, n: int = 10) -> DataFrame:
    """Query log grouped by query hash, more than 5 runs, top n by mean
    duration (HAVING + ordered limit)."""
    q = events.select(F.concat(F.lit("q"), F.get_json_object("props", "$.k")).alias("query_hash"),
                      (F.col("value") * 10).alias("duration_ms"))
    g = q.groupBy("query_hash").agg(F.count(F.lit(1)).alias("runs"), F.avg("duration_ms").alias("mean_ms"),
                                    F.max("duration_ms").alias("max_ms"))
    return g.filter(F.col("runs") > config.SLOW_QUERY_MIN_COUNT).orderBy(F.col("mean_ms").desc(), "query_hash").limit(n)


def cache_stats(events: DataFrame) -> DataFrame:
    """Response time min / mean / max and the hit rate (view / click
    events count as cache hits)."""
    hit = F.col("event_type").isin("view", "click")
    return events.agg(F.min("value").alias("min_ms"), F.avg("value").alias("mean_ms"), F.max("value").alias("max_ms"),
                      F.avg(hit.cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("requests"))


def digest_findings(scored: DataFrame) -> DataFrame:
    """Portfolio metrics from one aggregate, threshold rules as rows."""
    c = F.col
    m = scored.agg(F.avg("dqi_score").alias("mean_dqi"), (F.avg(c("tier2_clean").cast("double")) * 100).alias("tier2_clean_rate"),
                   (F.avg(c("dblock_tier1_ready").cast("double")) * 100).alias("dblock_ready_rate"),
                   (F.avg((c("total_issues_all_sources") > 0).cast("double")) * 100).alias("issue_rate"))
    ops = {">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    rows = F.array(*[F.when(ops[op](c(metric), thr), F.struct(F.lit(i).alias("ordinal"), F.lit(sev).alias("severity"),
                                                              F.lit(title).alias("title"), F.lit(metric).alias("metric"),
                                                              c(metric).alias("value")))
                     for i, (metric, op, thr, sev, title) in enumerate(config.DIGEST_RULES)])
    return m.select(F.explode(F.array_compact(rows)).alias("f")).select("f.*")
