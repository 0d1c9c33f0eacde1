"""Governance: audit hash chain (W13), calibration (A40-A42), trust rates
(A30-A32) and drift (A43)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.session import materialize_table


def previous_in_order(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Global `lag(value)` without a single-partition window.

    Rows are range-partitioned on the order key and written once with the
    number of their range, so rows and carried values see the same ranges;
    the lag inside a range is a window over it, and the first row of each
    range takes the last value of the nearest filled range before it.
    """
    x = materialize_table(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    last = x.groupBy("_p").agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    # one row per written range
    carry = last.select("_p", F.last("_last", ignorenulls=True).over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    w = Window.partitionBy("_p").orderBy(*order)
    x = x.withColumn(out, F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w)).join(carry, "_p")
    return x.withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col(out))) \
        .drop("_p", "_rn", "_carry")


def audit_entries(events: DataFrame) -> DataFrame:
    """Audit log with a stored checksum chain: checksum = sha256 of the
    entry, previous_checksum = checksum of the entry before it; a few
    entries were tampered (their previous_checksum does not match)."""
    e = events.select(F.col("event_id").alias("entry_id"), F.col("ts").alias("timestamp"),
                      F.col("user_id").alias("actor_id"), F.col("event_type"), F.col("value"),
                      F.sha2(F.concat_ws("|", "event_id", "ts", "user_id", "event_type", "value"), 256).alias("checksum"))
    e = previous_in_order(e, ["timestamp", "entry_id"], "checksum", "_prev")
    tampered = (F.col("entry_id") % 997) == 500
    return e.withColumn("previous_checksum",
                        F.when(tampered, F.sha2(F.col("entry_id").cast("string"), 256)).otherwise(F.col("_prev"))) \
        .drop("_prev")


def verify_chain(entries: DataFrame) -> DataFrame:
    """Each entry's previous_checksum must equal the checksum of the
    entry before it (global order by timestamp, id).  `broken_link` flags
    the bad links; `reported_invalid` flags every entry from the first
    break on (the original verifier stopped advancing after a break)."""
    x = previous_in_order(entries, ["timestamp", "entry_id"], "checksum", "_expected")
    x = x.withColumn("broken_link", F.col("_expected").isNotNull()
                     & (F.coalesce(F.col("previous_checksum"), F.lit("")) != F.col("_expected")))
    first = x.filter("broken_link").agg(F.min(F.struct("timestamp", "entry_id")).alias("_first"))
    x = x.crossJoin(F.broadcast(first))
    return x.select(*entries.columns, "broken_link",
                    (F.col("_first").isNotNull() & (F.struct("timestamp", "entry_id") >= F.col("_first")))
                    .alias("reported_invalid"))


def _credit(outcome: Column) -> Column:
    m = F.create_map(*[x for k, v in config.OUTCOME_CREDIT.items() for x in (F.lit(k), F.lit(v))])
    return m[outcome]


def _bin(conf: Column, n: int = config.CALIBRATION_BINS) -> Column:
    # numpy linspace edges; the last bin is closed on the right
    import numpy as np
    edges = [float(x) for x in np.linspace(0.0, 1.0, n + 1)]
    expr = None
    for i in range(n - 1, -1, -1):
        cond = conf >= F.lit(edges[i]) if i < n - 1 else (conf >= F.lit(edges[i])) & (conf <= F.lit(edges[i + 1]))
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr


def calibration_bins(pred: DataFrame, n: int = config.CALIBRATION_BINS) -> DataFrame:
    """Equal-width bins over predictions with a decided outcome: count,
    mean confidence, accuracy (modified = half credit), |acc - conf|.
    Empty bins come from a right join to the bin range."""
    import numpy as np
    edges = [float(x) for x in np.linspace(0.0, 1.0, n + 1)]
    v = pred.filter(F.col("outcome_type").isin(list(config.OUTCOME_CREDIT)))
    g = v.groupBy(_bin(F.col("confidence"), n).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"),
        F.avg(_credit(F.col("outcome_type"))).alias("accuracy"))
    spark = pred.sparkSession
    bins = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(n)], "bin int, bin_start double, bin_end double")
    out = bins.join(g, "bin", "left")
    return out.select("bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("count"),
                      F.coalesce("avg_confidence", (F.col("bin_start") + F.col("bin_end")) / 2).alias("avg_confidence"),
                      F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
                      F.when(F.col("count").isNull(), 0.0).otherwise(F.abs(F.col("accuracy") - F.col("avg_confidence")))
                      .alias("calibration_error"))


def calibration_metrics(pred: DataFrame, n: int = config.CALIBRATION_BINS) -> DataFrame:
    """ECE, MCE, Brier, accuracy and outcome rates, one row."""
    bins = calibration_bins(pred, n)
    b = bins.agg(F.sum("count").alias("_n"), F.sum(F.col("count") * F.col("calibration_error")).alias("_w"),
                 F.max("calibration_error").alias("maximum_calibration_error"))
    v = pred.filter(F.col("outcome_type").isin(list(config.OUTCOME_CREDIT)))
    c = _credit(F.col("outcome_type"))
    m = v.agg(F.count(F.lit(1)).alias("predictions_with_outcomes"),
              F.avg((F.col("confidence") - c) * (F.col("confidence") - c)).alias("brier_score"),
              F.avg(c).alias("overall_accuracy"),
              F.avg((F.col("outcome_type") == "accepted").cast("double")).alias("acceptance_rate"),
              F.avg((F.col("outcome_type") == "modified").cast("double")).alias("modification_rate"),
              F.avg((F.col("outcome_type") == "rejected").cast("double")).alias("rejection_rate"))
    t = pred.agg(F.count(F.lit(1)).alias("total_predictions"))
    out = t.crossJoin(m).crossJoin(b)
    ece = F.when(F.col("_n") > 0, F.col("_w") / F.col("_n")).otherwise(0.0)
    status = None
    for thr, lab in config.CALIBRATION_STATUS:
        status = F.when(ece < thr, lab) if status is None else status.when(ece < thr, lab)
    return out.select("total_predictions", "predictions_with_outcomes", ece.alias("expected_calibration_error"),
                      "maximum_calibration_error", "brier_score", "overall_accuracy", "acceptance_rate",
                      "modification_rate", "rejection_rate",
                      status.otherwise(config.CALIBRATION_STATUS_TOP).alias("calibration_status"))


def acceptance_by_agent(pred: DataFrame) -> DataFrame:
    """Per agent: total, decided, pending, accepted / modified /
    rejected counts and acceptance rate over decided."""
    o = F.col("outcome_type")
    g = pred.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("total"), F.count(o).alias("decided"), F.count(F.when(o.isNull(), 1)).alias("pending"),
        F.count(F.when(o == "accepted", 1)).alias("accepted"), F.count(F.when(o == "modified", 1)).alias("modified"),
        F.count(F.when(o == "rejected", 1)).alias("rejected"), F.avg("confidence").alias("avg_confidence"))
    return g.withColumn("acceptance_rate", F.when(F.col("decided") > 0, F.col("accepted") / F.col("decided")))


def _sev(ratio: Column) -> Column:
    expr = None
    for thr, lab in config.DRIFT_SEVERITY:
        expr = F.when(ratio >= thr, lab) if expr is None else expr.when(ratio >= thr, lab)
    return expr.otherwise("low")


def drift_alerts(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Compare two one-row metric frames; one alert row per rule that
    fires (accuracy drop, ECE increase, acceptance drop, rejection spike),
    severity by change / threshold (1.5 / 2 / 3)."""
    t = config.DRIFT_THRESHOLDS
    cur = current.select(*[F.col(c).alias(f"c_{c}") for c in current.columns])
    base = baseline.select(*[F.col(c).alias(f"b_{c}") for c in baseline.columns])
    x = cur.crossJoin(base)
    c = F.col
    rules = [
        ("accuracy_drift", "overall_accuracy", "accuracy_drop",
         F.when(c("b_overall_accuracy") > 0, (c("b_overall_accuracy") - c("c_overall_accuracy")) / c("b_overall_accuracy"))),
        ("calibration_drift", "expected_calibration_error", "ece_increase",
         c("c_expected_calibration_error") - c("b_expected_calibration_error")),
        ("acceptance_drift", "acceptance_rate", "acceptance_drop",
         F.when(c("b_acceptance_rate") > 0, (c("b_acceptance_rate") - c("c_acceptance_rate")) / c("b_acceptance_rate"))),
        ("acceptance_drift", "rejection_rate", "rejection_spike",
         F.when((c("c_rejection_rate") > 0) & (c("b_rejection_rate") > 0),
                (c("c_rejection_rate") - c("b_rejection_rate")) / c("b_rejection_rate"))),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(kind).alias("drift_type"), F.lit(m).alias("metric_name"),
                              ch.alias("change"), F.lit(t[th]).alias("threshold"), c(f"c_{m}").alias("current_value"),
                              c(f"b_{m}").alias("baseline_value")) for i, (kind, m, th, ch) in enumerate(rules)])
    y = x.select(F.explode(rows).alias("r")).select("r.*").filter(F.col("change") > F.col("threshold"))
    return y.withColumn("severity", _sev(F.col("change") / F.col("threshold")))


def recalibration_triggers(current: DataFrame, drift: DataFrame, days_since: int) -> DataFrame:
    """Threshold, performance, time and drift triggers as rows."""
    t = config.RECAL_THRESHOLDS
    c = F.col
    n_drift = drift.agg(F.count(F.lit(1)).alias("_d"))
    x = current.crossJoin(n_drift)
    rules = F.array(
        F.when(c("expected_calibration_error") > t["ece_threshold"], F.struct(F.lit("threshold").alias("trigger_type"),
                                                                              F.lit("ece").alias("metric"))),
        F.when(c("overall_accuracy") < t["accuracy_threshold"], F.struct(F.lit("performance").alias("trigger_type"),
                                                                         F.lit("accuracy").alias("metric"))),
        F.when(c("rejection_rate") > t["rejection_threshold"], F.struct(F.lit("performance").alias("trigger_type"),
                                                                        F.lit("rejection_rate").alias("metric"))),
        F.when(F.lit(days_since) > t["days_since_calibration"], F.struct(F.lit("time_based").alias("trigger_type"),
                                                                         F.lit("days_since_calibration").alias("metric"))),
        F.when(c("_d") > 0, F.struct(F.lit("drift").alias("trigger_type"), F.lit("drift_alerts").alias("metric"))))
    return x.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")
