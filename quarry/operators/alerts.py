"""Alert processing (P30, T1-T6, F5, A28) in batch form; the streaming
forms live in `quarry.streaming`.

T1 (dedup within 60 min of the last *kept* alert of the same key) and T2
(fatigue limits) hang on what was kept before; both are state machines run
by blocks (`operators.machines`), exactly and without a key in one task.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import ntz_lit
from quarry.operators import machines as MC


def classify_priority(title: Column, message: Column, category: Column) -> Column:
    """Urgent words, then high words, then the category default."""
    text = F.lower(F.concat_ws(" ", title, message))
    urgent = "|".join(re.escape(k) for k in config.URGENT_KEYWORDS)
    high = "|".join(re.escape(k) for k in config.HIGH_KEYWORDS)
    cat = F.create_map(*[x for k, v in config.CATEGORY_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.when(text.rlike(urgent), "urgent").when(text.rlike(high), "high") \
        .otherwise(F.coalesce(cat[category], F.lit("normal")))


def dedup_kept(alerts: DataFrame, key: str = "dedup_key", ts: str = "created_at", id_col: str = "alert_id",
               window_minutes: int = config.DEDUP_WINDOW_MINUTES) -> DataFrame:
    """An alert is kept if the last kept alert of its key is more than the
    window ago.  Run as a state machine by blocks of a key's alerts; ids are
    distinct."""
    rows = alerts.select(F.col(key).cast("string").alias("key"), MC.micros(ts).alias("us"), F.col(id_col).alias("id"), F.lit(0).alias("code"))
    found, _ = MC.outcomes(rows, MC.KeepFirst(window_minutes * 60_000_000))
    return alerts.join(found.select(F.col("id").alias(id_col), (F.col("outcome") == 1).alias("kept")), id_col)


def fatigue_filter(alerts: DataFrame, recipient: str = "recipient_id", ts: str = "created_at",
                   priority: str = "priority", category: str = "category",
                   per_hour: int = config.MAX_ALERTS_PER_HOUR, per_day: int = config.MAX_ALERTS_PER_DAY) -> DataFrame:
    """Suppress a non-urgent, non-safety alert when the recipient already
    got `per_hour` unsuppressed alerts in the last hour or `per_day` in the
    last day (counting only unsuppressed ones, exempt ones included).

    Run as a state machine by blocks of a recipient's alerts; alert ids are
    distinct."""
    exempt = F.coalesce((F.col(priority) == "urgent") | (F.col(category) == "safety"), F.lit(False))
    rows = alerts.select(F.col(recipient).cast("string").alias("key"), MC.micros(ts).alias("us"), F.col("alert_id").alias("id"), exempt.cast("int").alias("code"))
    held, _ = MC.outcomes(rows, MC.Fatigue(per_hour, per_day))
    held = held.select(F.col("id").alias("alert_id"), (F.col("outcome") == 1).alias("suppressed"))
    return alerts.join(held, "alert_id").select(*alerts.columns, "suppressed", F.when(F.col("suppressed"), "fatigue_limit").alias("suppression_reason"))


def in_quiet_hours(ts: Column, start: str = config.QUIET_HOURS[0], end: str = config.QUIET_HOURS[1]) -> Column:
    """HH:mm inside [start, end], wrapping over midnight when start > end."""
    hm = F.date_format(ts, "HH:mm")
    if start > end:
        return (hm >= start) | (hm <= end)
    return (hm >= start) & (hm <= end)


def route_channel(priority: Column) -> Column:
    """T5: delivery channel by priority (broadcast-size map literal)."""
    m = F.create_map(*[x for k, v in config.CHANNEL_BY_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[priority], F.lit("in_app"))


def daily_digest(alerts: DataFrame, ts: str = "created_at") -> DataFrame:
    """T4: low / normal alerts per user per day (tumbling 1-day window):
    count and the sorted id list."""
    x = alerts.filter(F.col("priority").isin("low", "normal"))
    return x.groupBy("recipient_id", F.window(ts, "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("alerts"), F.sort_array(F.collect_list("alert_id")).alias("alert_ids")) \
        .select("recipient_id", F.col("w.start").alias("day"), "alerts", "alert_ids")


def windowed_counts(alerts: DataFrame, ts: str = "created_at", size: str = "1 hour") -> DataFrame:
    """Alert counts per tumbling window and category."""
    return alerts.groupBy(F.window(ts, size).alias("w"), "category").agg(F.count(F.lit(1)).alias("alerts")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category", "alerts")


def alert_statistics(alerts: DataFrame, as_of) -> DataFrame:
    """Totals by status / priority / category and last hour / day, one
    aggregate pass then unpivoted."""
    now = ntz_lit(as_of)
    x = alerts.select(F.explode(F.array(
        F.struct(F.lit("priority").alias("dimension"), F.col("priority").alias("value")),
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")),
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")))).alias("d"), "created_at")
    return x.groupBy("d.dimension", "d.value").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count(F.when(F.col("created_at") >= now - F.expr("INTERVAL 1 HOUR"), 1)).alias("last_hour"),
        F.count(F.when(F.col("created_at") >= now - F.expr("INTERVAL 1 DAY"), 1)).alias("last_day"))
