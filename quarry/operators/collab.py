"""Issue registry read side."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import epoch_micros, ntz_lit


def _hours_between(later: Column, earlier: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / 3.6e9


def issue_sla(issues: DataFrame, as_of: dt.datetime) -> DataFrame:
    """SLA hours by priority (72 when unknown), due date, overdue flag
    for non-terminal issues, age and hours remaining at `as_of`."""
    sla = F.create_map(*[x for k, v in config.SLA_HOURS.items() for x in (F.lit(k), F.lit(v))])
    now = ntz_lit(as_of)
    hours = F.coalesce(sla[F.col("priority")], F.lit(72))
    due = F.col("created_at") + F.make_interval(hours=hours)
    out = issues.select("*", hours.alias("sla_hours"), due.cast("timestamp_ntz").alias("due_date"))
    return out.select("*", (~F.col("status").isin(config.TERMINAL_STATUSES) & (now > F.col("due_date")))
                      .alias("is_overdue"), _hours_between(now, F.col("created_at")).alias("age_hours"),
                      F.greatest(_hours_between(F.col("due_date"), now), F.lit(0.0)).alias("hours_remaining"))


def transition_check(log: DataFrame) -> DataFrame:
    """Each status change against the allowed-transition table (a
    broadcast rule table) using the previous status of the same issue.
    Issue histories are short, so the per-issue window stays small."""
    rules = [(a, b) for a, bs in config.STATUS_TRANSITIONS.items() for b in bs]
    allowed = log.sparkSession.createDataFrame(rules, "prev_status string, status string") \
        .withColumn("allowed", F.lit(True))
    w = Window.partitionBy("issue_id").orderBy("seq", "ts", "status")
    x = log.withColumn("prev_status", F.lag("status").over(w))
    x = x.join(F.broadcast(allowed), ["prev_status", "status"], "left")
    return x.select("issue_id", "seq", "ts", "prev_status", "status",
                    F.when(F.col("prev_status").isNull(), True).otherwise(F.coalesce("allowed", F.lit(False)))
                    .alias("valid_transition"))


def current_state(log: DataFrame) -> DataFrame:
    """Latest status per issue (max_by on the ordering key), plus the
    count of changes, first and last change time: one aggregate."""
    return log.groupBy("issue_id").agg(F.max_by("status", F.struct("ts", "seq", "status")).alias("current_status"),
                                       F.count(F.lit(1)).alias("changes"), F.min("ts").alias("first_change"),
                                       F.max("ts").alias("last_change"))


def rules_frame(spark) -> DataFrame:
    return spark.createDataFrame(
        [(r, lv, t, h, p, c) for r, lv, t, h, p, c in config.ESCALATION_RULES],
        "rule_id string, level int, trigger_type string, trigger_hours int, priorities array<string>, "
        "categories array<string>")


def escalation_candidates(issues: DataFrame, as_of: dt.datetime, current_level: Column | None = None) -> DataFrame:
    """Issues x rules (theta join against the broadcast rule table):
    level above the issue's highest escalation, priority / category /
    status lists, age threshold only for time-based rules.  Every
    qualifying rule fires."""
    rules = F.broadcast(rules_frame(issues.sparkSession))
    age = _hours_between(ntz_lit(as_of), F.col("created_at"))
    lvl = current_level if current_level is not None else F.lit(0)
    i = issues.select("issue_id", F.lower("priority").alias("priority"), F.lower("category").alias("category"),
                      F.lower("status").alias("status"), age.alias("age_hours"), lvl.alias("highest_level"))
    cond = ((F.col("level") > F.col("highest_level"))
            & ((F.size("priorities") == 0) | F.array_contains("priorities", F.col("priority")))
            & ((F.size("categories") == 0) | F.array_contains("categories", F.col("category")))
            & F.col("status").isin(config.ESCALATION_DEFAULT_STATUSES)
            & ((F.col("trigger_type") != "time_based") | (F.col("age_hours") >= F.col("trigger_hours"))))
    return i.join(rules, cond, "inner").select("issue_id", "rule_id", "level", "trigger_type", "priority",
                                               "category", "status", "age_hours")


def escalation_stats(esc: DataFrame) -> DataFrame:
    """Escalations by level and trigger, mean issue age (hours)."""
    return esc.groupBy("level", "trigger_type").agg(F.count(F.lit(1)).alias("escalations"),
                                                    F.count_distinct("issue_id").alias("issues"),
                                                    F.avg("age_hours").alias("avg_age_hours"))


def search(issues: DataFrame, *, statuses=None, priorities=None, categories=None, text: str | None = None,
           created_from=None, created_to=None, order_by: str = "created_at", descending: bool = True,
           limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """optional predicates composed into one filter (pushed to the scan
    where possible), a total count and one ordered page (offset + limit are
    the paging feature)."""
    cond = F.lit(True)
    if statuses:
        cond = cond & F.col("status").isin(list(statuses))
    if priorities:
        cond = cond & F.col("priority").isin(list(priorities))
    if categories:
        cond = cond & F.col("category").isin(list(categories))
    if text:
        cond = cond & F.lower(F.col("title")).contains(text.lower())
    if created_from is not None:
        cond = cond & (F.col("created_at") >= ntz_lit(created_from))
    if created_to is not None:
        cond = cond & (F.col("created_at") < ntz_lit(created_to))
    hit = issues.filter(cond)
    o = F.col(order_by).desc() if descending else F.col(order_by).asc()
    page = hit.orderBy(o, F.col("issue_id").asc()).offset(offset).limit(limit)
    return page, hit.agg(F.count(F.lit(1)).alias("total"))


def distributions(issues: DataFrame, top: int = 10) -> DataFrame:
    """Counts by status, priority and category in one pass (grouping
    sets), each list cut to its top 10 by count (the report's feature)."""
    rows = issues.select(F.explode(F.array(
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")),
        F.struct(F.lit("priority").alias("dimension"), F.col("priority").alias("value")),
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")))).alias("d"))
    counts = rows.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("dimension").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def escalation_timeline(issues: DataFrame, until: dt.datetime, check_hours: int = 24) -> DataFrame:
    """Escalation checks every `check_hours` as time passes.

    A rule becomes eligible at creation + trigger hours (time-based) or at
    creation (other triggers); it is acted on at the first check at or after
    that moment.  At a check, every eligible rule above the highest level
    escalated before fires; the highest level escalated before a check equals
    the highest level of all rules eligible at earlier checks, so firing is a
    per-issue window over its (at most nine) rule rows."""
    rules = F.broadcast(rules_frame(issues.sparkSession))
    i = issues.select("issue_id", F.lower("priority").alias("priority"), F.lower("category").alias("category"),
                      F.lower("status").alias("status"), "created_at")
    cond = (((F.size("priorities") == 0) | F.array_contains("priorities", F.col("priority")))
            & ((F.size("categories") == 0) | F.array_contains("categories", F.col("category")))
            & F.col("status").isin(config.ESCALATION_DEFAULT_STATUSES))
    x = i.join(rules, cond, "inner")
    hours = F.when(F.col("trigger_type") == "time_based", F.col("trigger_hours")).otherwise(F.lit(0))
    elig_us = epoch_micros(F.col("created_at")) + hours.cast("long") * 3_600_000_000
    period = check_hours * 3_600_000_000
    check = F.ceil(elig_us / F.lit(period)).cast("long")
    x = x.select("issue_id", "rule_id", "level", "trigger_type", check.alias("check_no"))
    x = x.filter(F.col("check_no") * period <= epoch_micros(ntz_lit(until)))
    w = Window.partitionBy("issue_id").orderBy("check_no").rangeBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_before", F.coalesce(F.max("level").over(w), F.lit(0)))
    return x.select("issue_id", "rule_id", "level", "trigger_type", "check_no", (F.col("level") > F.col("_before")).alias("fired"))


def approval_status(fired: DataFrame, log: DataFrame, until: dt.datetime, check_hours: int = 24) -> DataFrame:
    """Every fired escalation opens an approval at its check time that
    expires after a level-dependent number of hours; it is approved by the
    issue's first status change after the request (the issue's own short
    history is joined, never a group of unbounded size), expired when the
    expiry passed first, pending otherwise."""
    exp = F.create_map(*[x for k, v in config.APPROVAL_EXPIRY_HOURS_BY_LEVEL.items() for x in (F.lit(k), F.lit(v))])
    period = check_hours * 3_600_000_000
    a = fired.filter("fired").select("issue_id", "rule_id", "level", (F.col("check_no") * period).alias("req_us"))
    a = a.withColumn("exp_us", F.col("req_us") + exp[F.col("level")].cast("long") * 3_600_000_000)
    changes = log.select("issue_id", epoch_micros(F.col("ts")).alias("ch_us"))
    first = a.join(changes, "issue_id", "left").filter(F.col("ch_us").isNull() | (F.col("ch_us") > F.col("req_us"))) \
        .groupBy("issue_id", "rule_id", "level", "req_us", "exp_us").agg(F.min("ch_us").alias("first_change_us"))
    a = a.join(first.select("issue_id", "rule_id", "first_change_us"), ["issue_id", "rule_id"], "left")
    now = epoch_micros(ntz_lit(until))
    status = F.when(F.col("first_change_us").isNotNull() & (F.col("first_change_us") <= F.col("exp_us")), "approved") \
        .when(now > F.col("exp_us"), "expired").otherwise("pending")
    return a.select("issue_id", "rule_id", "level", "req_us", "exp_us", status.alias("approval_status"))
