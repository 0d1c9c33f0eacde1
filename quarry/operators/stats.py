"""Activity, study and issue statistics (A9, A29, A34, A37, J6, J7, J9, P20, P23-P25,
W14, X9): conditional aggregates, expressions and windows per small key."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.quantiles import exact_quantiles

TOP_ACTORS = 10
SHORT_DAYS, MEDIUM_DAYS = 7, 30
ISSUE_KEYWORDS = {"query": "has_query", "sae": "has_sae", "lab": "has_lab", "visit": "has_visit", "coding": "has_coding", "signature": "has_signature"}


def audit_statistics(entries: DataFrame) -> DataFrame:
    """Entries, successes, failures and success rate, over all and by
    event type, severity and actor (the ten busiest; ties by id).  One pass
    counts by the finest key, the rest adds those counts up."""
    fine = entries.groupBy("event_type", "severity", "actor_id").agg(
        F.count("*").alias("entries"), F.count_if("success").alias("successes"))

    def by(dimension: str, value: Column) -> DataFrame:
        return fine.groupBy(F.lit(dimension).alias("dimension"), value.cast("string").alias("value")).agg(
            F.sum("entries").alias("entries"), F.sum("successes").alias("successes"))

    actors = by("actor", F.col("actor_id")).orderBy(F.desc("entries"), F.col("value").cast("long")).limit(TOP_ACTORS)
    out = by("all", F.lit("all")).unionByName(by("event_type", F.col("event_type"))).unionByName(by("severity", F.col("severity"))).unionByName(actors)
    return out.select("*", (F.col("entries") - F.col("successes")).alias("failures"), (F.col("successes") * 100.0 / F.col("entries")).alias("success_rate"))


def daily_usage(usage: DataFrame) -> DataFrame:
    """Uses and users of each feature by day."""
    return usage.groupBy(F.to_date("timestamp").alias("day"), "feature").agg(
        F.count("*").alias("usage_count"), F.count_distinct("user_id").alias("unique_users"))


def feedback_summary(interactions: DataFrame) -> DataFrame:
    """Feedback counts and rates of every agent and of all."""
    kinds = {"accepts": ("accepted", "auto_executed"), "modifies": ("accepted_modified",), "rejects": ("rejected",), "overrides": ("overridden",)}
    g = interactions.where("outcome IS NOT NULL").rollup("agent_name").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("outcome").isin(*v)).alias(k) for k, v in kinds.items()])
    return g.select(F.coalesce("agent_name", F.lit("all")).alias("agent_name"), "total", *kinds,
                    ((F.col("accepts") + F.col("modifies")) / F.col("total")).alias("acceptance_rate"),
                    (F.col("rejects") / F.col("total")).alias("rejection_rate"), (F.col("overrides") / F.col("total")).alias("override_rate"))


def outcomes_by_agent(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with an outcome, counted by action, agent and outcome."""
    return predictions.join(outcomes, "prediction_id").groupBy("action_type", "agent_name", "outcome_type").agg(F.count("*").alias("decisions"))


def winsorised(df: DataFrame, value: str, group: str, q: float = 0.99, factor: float = 2.0) -> DataFrame:
    """P20: mean and maximum per group before and after clipping to
    [0, factor x quantile], with the number of clipped rows."""
    limit = exact_quantiles(df, [value], [q])[value][0]
    x = df.withColumn("limit", F.lit(None if limit is None else limit * factor).cast("double"))
    v = F.col(value).cast("double")
    clipped = F.greatest(F.lit(0.0), F.least(v, F.col("limit")))
    return x.groupBy(group, "limit").agg(F.avg(v).alias("mean_before"), F.avg(clipped).alias("mean_after"), F.max(clipped).alias("max_after"),
                                         F.count_if(v != clipped).alias("clipped"))


def calendar_features(ts: str) -> list[Column]:
    """Parts of a time and flags on them (Monday is day 0); missing times
    count as a Wednesday noon in June."""
    day = F.coalesce(F.weekday(ts), F.lit(2))
    month = F.month(ts)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return [day.alias("open_day_of_week"), F.coalesce(F.hour(ts), F.lit(12)).alias("open_hour"), F.coalesce(month, F.lit(6)).alias("open_month"),
            flag(day >= 5).alias("open_is_weekend"), flag(day == 0).alias("open_is_monday"), flag(day == 4).alias("open_is_friday"),
            flag(F.dayofmonth(ts) >= 25).alias("open_is_end_of_month"), flag(F.dayofmonth(ts) <= 5).alias("open_is_start_of_month"),
            flag(month.isin(11, 12, 1)).alias("open_is_holiday_season"), flag(month.isin(6, 7, 8)).alias("open_is_summer"),
            flag(F.quarter(ts) == 4).alias("open_is_q4"), flag(F.quarter(ts) == 1).alias("open_is_q1")]


def issue_features(issues: DataFrame, log: DataFrame, text: Sequence[str] = ("category", "title")) -> DataFrame:
    """Calendar parts of the opening, keyword flags over the issue's
    text, days to the last status change and their class (0 short, 1 medium,
    2 long; null if there was none or it lies before the opening)."""
    last = log.groupBy("issue_id").agg(F.max("ts").alias("answered_at"))
    words = F.lower(F.concat_ws(" ", *text))
    flags = [words.contains(k).cast("int").alias(name) for k, name in ISSUE_KEYWORDS.items()]
    days = F.date_diff("answered_at", "created_at")
    x = issues.join(last, "issue_id", "left").select("issue_id", *calendar_features("created_at"), *flags, F.when(days >= 0, days).alias("resolution_days"))
    d = F.col("resolution_days")
    return x.withColumn("duration_class", F.when(d <= SHORT_DAYS, 0).when(d <= MEDIUM_DAYS, 1).when(d > MEDIUM_DAYS, 2))


def with_neighbours(rows: DataFrame, key: str, order: Sequence[str], text: str, reach: int = 1) -> DataFrame:
    """Every piece of a document with the pieces around it, `reach` to
    either side; the window stays inside one document."""
    w = Window.partitionBy(key).orderBy(*order)
    before = [F.lag(text, k).over(w) for k in range(reach, 0, -1)]
    after = [F.lead(text, k).over(w) for k in range(1, reach + 1)]
    return rows.select("*", F.concat_ws(" ", *before, text, *after).alias("context"))


def issue_timeline(issues: DataFrame, log: DataFrame) -> DataFrame:
    """The creation of every issue and its status changes as one timeline,
    numbered by time (creation first at the same time, then by entry and status)."""
    made = issues.select("issue_id", F.col("created_at").alias("ts"), F.lit(0).cast("long").alias("entry"), F.lit("created").alias("event"), "status")
    changed = log.select("issue_id", "ts", F.col("seq").cast("long").alias("entry"), F.lit("status_changed").alias("event"), "status")
    w = Window.partitionBy("issue_id").orderBy("ts", "entry", "status")
    return made.unionByName(changed).withColumn("position", F.row_number().over(w))


def study_metrics(patients: DataFrame, dqi: DataFrame, clean: DataFrame, lock: DataFrame, issues: DataFrame, low: float = 90.0) -> DataFrame:
    """Patients of each study, and left-joined what five other
    aggregates know of it: its sites (with the worst site mean and the sites
    under `low`), mean score, clean rates, lock readiness among the eligible,
    and issue totals; 0 where a table has no row of the study.

    Aggregates of one and the same frame are made in one pass over it."""
    rate = lambda c: (F.avg(F.col(c).cast("double")) * 100).alias(f"{c.split('_')[0]}_rate")
    parts = [(dqi, [F.avg("dqi_score").alias("mean_dqi")]), (clean, [rate("tier1_clean"), rate("tier2_clean")]),
             (lock, [F.count_if("dblock_tier1_ready").alias("lock_ready"), F.count_if("dblock_eligible").alias("lock_eligible")]),
             (issues, [F.sum("total_issues").alias("total_issues")])]
    frames: dict[int, tuple[DataFrame, list[Column]]] = {}
    for frame, aggs in parts:
        frames.setdefault(id(frame), (frame, []))[1].extend(aggs)
    out = patients.groupBy("study_id").agg(F.count("*").alias("patients"))
    sites = dqi.groupBy("study_id", "site_id").agg(F.avg("dqi_score").alias("mean"))
    sites = sites.groupBy("study_id").agg(F.count("site_id").alias("sites"), F.min("mean").alias("worst_site_dqi"), F.count_if(F.col("mean") < low).alias("low_sites"))
    out = out.join(sites, "study_id", "left")
    for frame, aggs in frames.values():
        out = out.join(frame.groupBy("study_id").agg(*aggs), "study_id", "left")
    out = out.fillna(0)
    return out.withColumn("lock_rate", F.when(F.col("lock_eligible") > 0, F.col("lock_ready") * 100.0 / F.col("lock_eligible")).otherwise(0.0))


def by_region(metrics: DataFrame, lookup: DataFrame) -> DataFrame:
    """Site metrics get their region from a lookup of all rows, one per
    site (its first region by name); sites without one are `Unknown`."""
    one = lookup.groupBy("site_id").agg(F.min("region").alias("region"))
    x = metrics.join(one, "site_id", "left").withColumn("region", F.coalesce("region", F.lit("Unknown")))
    return x.groupBy("region").agg(F.count("*").alias("sites"), F.sum("patients").alias("patients"), F.avg("dqi_mean").alias("mean_of_sites"))
