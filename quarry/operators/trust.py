"""Trust metrics (A30-A33, A35, A36): conditional aggregates over an
interaction log, in one pass per period; the composite is a select over the
one-row result."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import ntz_lit, round_half_even


def _period(ts: Column, start: dt.datetime, end: dt.datetime) -> Column:
    return (ts >= ntz_lit(start)) & (ts < ntz_lit(end))


def period_metrics(x: DataFrame, start: dt.datetime, end: dt.datetime, prefix: str = "") -> DataFrame:
    c = F.col
    p = _period(c("timestamp"), start, end)
    o = c("outcome")
    n = F.count(F.when(p & o.isNotNull(), 1))
    return x.agg(
        n.alias(f"{prefix}total_interactions"),
        F.count(F.when(p & (o == "overridden"), 1)).alias(f"{prefix}overrides"),
        F.count(F.when(p & (o == "accepted"), 1)).alias(f"{prefix}accepted"),
        F.count(F.when(p & (o == "accepted_modified"), 1)).alias(f"{prefix}accepted_modified"),
        F.count(F.when(p & (o == "rejected"), 1)).alias(f"{prefix}rejected"),
        F.count(F.when(p & (o == "auto_executed"), 1)).alias(f"{prefix}auto_executed"),
        F.avg(F.when(p & o.isNotNull(), c("time_to_decision_seconds"))).alias(f"{prefix}avg_decision_seconds"),
        F.count(F.when(p & c("rating").isNotNull(), 1)).alias(f"{prefix}satisfaction_count"),
        F.avg(F.when(p, c("rating"))).alias(f"{prefix}avg_rating_raw"),
        F.count(F.when(p & (c("would_recommend") == 1), 1)).alias(f"{prefix}promoters"),
        F.count(F.when(p & (c("would_recommend") == 0), 1)).alias(f"{prefix}detractors"),
        F.count_distinct(F.when(p, c("user_id"))).alias(f"{prefix}active_users"))


def trust_metrics(x: DataFrame, as_of: dt.datetime, days: int = config.TRUST_PERIOD_DAYS) -> DataFrame:
    """A30 override / acceptance, A32 satisfaction and NPS, A33 adoption,
    A35 trends against the previous period, A36 composite score and level."""
    c = F.col
    cur = period_metrics(x, as_of - dt.timedelta(days=days), as_of)
    prev = period_metrics(x, as_of - dt.timedelta(days=2 * days), as_of - dt.timedelta(days=days), "p_")
    users = x.agg(F.count_distinct("user_id").alias("total_users"))
    m = cur.crossJoin(prev).crossJoin(users)
    tot = c("total_interactions")
    rate = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    m = m.select(
        "*",
        rate(c("overrides"), tot).alias("override_rate"),
        rate(c("accepted") + c("accepted_modified") + c("auto_executed"), tot).alias("acceptance_rate"),
        rate(c("accepted_modified"), tot).alias("modification_rate"),
        F.coalesce(c("avg_rating_raw"), F.lit(0.0)).alias("avg_rating_full"),
        rate((c("promoters") - c("detractors")) * 100.0, c("promoters") + c("detractors")).alias("nps_full"),
        rate(c("active_users"), c("total_users")).alias("adoption_rate"),
        rate(c("p_overrides"), c("p_total_interactions")).alias("_prev_override"),
        F.coalesce(c("p_avg_rating_raw"), F.lit(0.0)).alias("_prev_rating"))
    w = config.TRUST_WEIGHTS
    sat = F.when(c("avg_rating_full") > 0, c("avg_rating_full") / 5 * 100).otherwise(F.lit(50.0))
    score = (c("acceptance_rate") * 100 * w["acceptance"] + sat * w["satisfaction"] + c("adoption_rate") * 100 * w["adoption"]
             + (F.lit(100.0) - c("override_rate") * 50) * w["override"])
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    lvl = None
    for thr, lab in config.TRUST_LEVELS:
        lvl = F.when(score >= thr, lab) if lvl is None else lvl.when(score >= thr, lab)

    def trend(cur_v, prev_v, lower_is_better):
        ch = (cur_v - prev_v) / prev_v
        good, bad = (ch < -config.TREND_CHANGE, ch > config.TREND_CHANGE) if lower_is_better else \
            (ch > config.TREND_CHANGE, ch < -config.TREND_CHANGE)
        return F.when(prev_v == 0, "stable").when(good, "improving").when(bad, "declining").otherwise("stable")

    return m.select(
        "total_interactions", "overrides", "override_rate", "accepted", "accepted_modified", "rejected", "acceptance_rate",
        "modification_rate", "avg_decision_seconds", "satisfaction_count",
        round_half_even(c("avg_rating_full"), 2).alias("avg_satisfaction"), round_half_even(c("nps_full"), 1).alias("nps_score"),
        "promoters", "detractors", "active_users", "total_users", "adoption_rate",
        trend(c("override_rate"), c("_prev_override"), True).alias("override_rate_trend"),
        trend(c("avg_rating_full"), c("_prev_rating"), False).alias("satisfaction_trend"),
        round_half_even(score, 1).alias("trust_score"), lvl.otherwise(config.TRUST_LEVEL_FLOOR).alias("trust_level"))


def acceptance_by_agent(x: DataFrame, as_of: dt.datetime, days: int = config.TRUST_PERIOD_DAYS) -> DataFrame:
    """Per agent accepted (incl. modified and auto) over decided."""
    p = _period(F.col("timestamp"), as_of - dt.timedelta(days=days), as_of) & F.col("outcome").isNotNull()
    o = F.col("outcome")
    g = x.filter(p).groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(o.isin("accepted", "accepted_modified", "auto_executed"), 1)).alias("accepted"),
        F.count(F.when(o == "rejected", 1)).alias("rejected"), F.count(F.when(o == "overridden", 1)).alias("overridden"))
    return g.withColumn("acceptance_rate", F.col("accepted") / F.col("total"))


def learning_signals(x: DataFrame) -> DataFrame:
    """Each decided interaction yields one or two learning signals:
    rejection -> negative (strength 1.0) plus a calibration signal when the
    decision was fast; modification -> partial (0.5); acceptance ->
    positive (0.3); override -> negative (0.8) plus a policy-review signal."""
    o, t = F.col("outcome"), F.col("time_to_decision_seconds")
    sig = lambda typ, s: F.struct(F.lit(typ).alias("signal_type"), F.lit(s).alias("strength"))
    arr = (F.when(o == "rejected", F.array(sig("negative", 1.0), F.when(t < 30, sig("calibration", 0.6))))
           .when(o == "accepted_modified", F.array(sig("partial", 0.5)))
           .when(o == "accepted", F.array(sig("positive", 0.3)))
           .when(o == "overridden", F.array(sig("negative", 0.8), sig("policy_review", 0.4)))
           .otherwise(F.array()))
    return x.select("event_id", "agent_name", "timestamp", F.explode(F.array_compact(arr)).alias("s")) \
        .select("event_id", "agent_name", "timestamp", "s.signal_type", "s.strength")


def signal_summary(signals: DataFrame) -> DataFrame:
    """Signals by agent and type: count and mean strength."""
    return signals.groupBy("agent_name", "signal_type").agg(F.count(F.lit(1)).alias("signals"),
                                                          F.avg("strength").alias("avg_strength"))
