"""Streaming alert processing.

Sources are file streams over the event table; sinks are parquet folders
under the cluster's shared checkpoint folder (file sink, append mode), so a
restarted query resumes from its checkpoint and no result passes through
the driver.

* T6 / T4 - tumbling-window counts and digests with a watermark.
* T12     - session windows of user activity.
            T6 and T12 append what the watermark has passed, so the state
            holds open windows only; the end of the input flushes those.
* T1, T2, T11 - dedup, fatigue and circuit states: state machines run by
            blocks on each trigger's rows (`operators.machines`), with the
            states kept between triggers in a table.
* T9      - `foreachBatch` sums of each batch by day, added up on read.
Rows later than the watermark are dropped by Spark's stateful operators.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import machines as MC
from quarry.session import ensure_checkpoint_dir
from quarry.sources.tables import load


def event_stream(spark: SparkSession, sf_dir: str, stream: bool = True) -> DataFrame:
    """The event table as a stream (or, without `stream`, as it is), whether it
    is one file or a folder of files; a trigger takes all that has come since
    the last one."""
    schema = load(spark, sf_dir, "events").schema
    # event-time columns must be TIMESTAMP for watermarks; results are cast
    # back to TIMESTAMP_NTZ (a round trip in the session time zone)
    return ((spark.readStream if stream else spark.read).schema(schema).parquet(f"{sf_dir}/{{events.parquet}}")  # a pattern: one file will do as well as a folder
            .withColumn("ts", F.col("ts").cast("timestamp")))


def alert_stream(spark: SparkSession, sf_dir: str, stream: bool = True) -> DataFrame:
    """The alert columns of `quarry.sources.testmap.alerts`, on a stream."""
    from quarry.operators.alerts import classify_priority
    from quarry.sources.testmap import EVENT_CATEGORY, _map
    ev = event_stream(spark, sf_dir, stream)
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    cat = F.when((F.col("event_type") == "error") & (k < 10), "safety").otherwise(
        _map(F.col("event_type"), EVENT_CATEGORY, "system"))
    title = F.when(k % 20 == 0, F.concat(F.lit("URGENT: item "), k.cast("string"))) \
        .when(k % 20 == 1, F.concat(F.lit("Overdue item "), k.cast("string"))) \
        .otherwise(F.concat(F.lit("Update on item "), k.cast("string")))
    a = ev.select(F.col("event_id").alias("alert_id"), F.col("ts").alias("created_at"),
                  F.col("user_id").alias("recipient_id"), cat.alias("category"), title.alias("title"),
                  F.concat(F.lit("value "), F.col("value").cast("string")).alias("message"),
                  F.concat(F.col("event_type"), F.lit(":"), (k % 10).cast("string")).alias("dedup_key"),
                  k.alias("k"), F.col("value"))
    return a.withColumn("priority", classify_priority(F.col("title"), F.col("message"), F.col("category")))


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/quarry-streams/{name}-{uuid.uuid4().hex[:10]}"
    return base + "/out", base + "/checkpoint"


def run_to_parquet(df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Drain everything available (availableNow trigger) into a parquet
    folder and return a batch scan of it."""
    spark = df.sparkSession
    out, ckpt = _paths(spark, name)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def hourly_counts(alerts: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Alerts per tumbling hour and category; a window is emitted once
    the watermark passes its end."""
    return (alerts.withWatermark("created_at", watermark)
            .groupBy(F.window("created_at", "1 hour").alias("w"), "category")
            .agg(F.count(F.lit(1)).alias("alerts"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category", "alerts"))


def all_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 over all input: windows are appended and leave the state when the
    watermark passes them; those still open at the end of the input, whose rows
    are no earlier than the last emitted end, are counted once from there."""
    done = run_to_parquet(hourly_counts(alert_stream(spark, sf_dir)), "t6")
    last = done.agg(F.max("window_end")).first()[0]
    rest = alert_stream(spark, sf_dir, stream=False)
    return done.unionByName(hourly_counts(rest if last is None else rest.where(F.col("created_at") >= F.lit(last))))


def all_usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 over all input: sessions are appended once the watermark passes
    their end; what follows a user's last emitted session is still open at the
    end of the input and is made into sessions once."""
    done = run_to_parquet(usage_sessions(event_stream(spark, sf_dir)), "t12")
    ends = done.groupBy(F.col("user_id").alias("_user")).agg(F.max("session_end").alias("_end"))
    rest = event_stream(spark, sf_dir, stream=False)
    rest = rest.join(ends, F.col("user_id").eqNullSafe(F.col("_user")), "left").where(F.col("_end").isNull() | (F.col("ts") >= F.col("_end"))).drop("_user", "_end")
    return done.unionByName(usage_sessions(rest))


def daily_digest(alerts: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T4: low / normal alerts per user per day."""
    x = alerts.filter(F.col("priority").isin("low", "normal")).withWatermark("created_at", watermark)
    return (x.groupBy("recipient_id", F.window("created_at", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("alerts"), F.sort_array(F.collect_list("alert_id")).alias("alert_ids"))
            .select("recipient_id", F.col("w.start").alias("day"), "alerts", "alert_ids"))


def usage_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Per user activity sessions split at 30-minute gaps."""
    return (events.withWatermark("ts", watermark)
            .groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
            .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events",
                    "value"))


def run_machine(rows: DataFrame, machine: MC.Machine, name: str) -> DataFrame:
    """Drain a stream of rows (key, us, id, code) through a state machine and
    return a batch scan of (key, us, id, outcome).

    Each trigger runs the machine by blocks on its rows, from the states that
    the trigger before left; outcomes and states are written under the
    trigger's number, so one that is replayed replaces its own.  A key's rows
    are in no task and in no state; a row that comes after later ones is taken
    with the trigger it comes in.  States that say no more than the initial one
    are dropped."""
    spark = rows.sparkSession
    out, ckpt = _paths(spark, name)
    states = out.removesuffix("/out") + "/states"

    def write(batch: DataFrame, epoch: int) -> None:
        given = spark.read.schema("key string, state array<bigint>").parquet(f"{states}/epoch={epoch - 1}") if epoch else None
        found, left = MC.outcomes(batch, machine, given)
        found.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if given is not None:
            left = left.unionByName(given.join(left.select("key"), "key", "left_anti"))
        if machine.forgets:
            latest = batch.agg(F.max("us")).first()[0]
            if latest is not None:
                left = left.where(F.element_at("state", -1) >= latest - machine.forgets - MC.HOUR)
        else:
            left = left.where(F.col("state") != F.array(*[F.lit(v).cast("bigint") for v in machine.initial]))
        left.write.mode("overwrite").parquet(f"{states}/epoch={epoch}")
        if epoch > 1:  # a replay needs the one before, no older ones
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{states}/epoch={epoch - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("key string, us bigint, id bigint, outcome int, epoch int").parquet(out).drop("epoch")


def dedup_stream(alerts: DataFrame, window_minutes: int = config.DEDUP_WINDOW_MINUTES) -> DataFrame:
    """The state of a key is the time of its last kept alert."""
    rows = alerts.select(F.col("dedup_key").alias("key"), MC.micros("created_at").alias("us"), F.col("alert_id").alias("id"), F.lit(0).alias("code"))
    kept = run_machine(rows, MC.KeepFirst(window_minutes * 60_000_000), "t1")
    return kept.select(F.col("id").alias("alert_id"), F.col("key").alias("dedup_key"), (F.col("outcome") == 1).alias("kept"))


def fatigue_stream(alerts: DataFrame, per_hour: int = config.MAX_ALERTS_PER_HOUR,
                   per_day: int = config.MAX_ALERTS_PER_DAY) -> DataFrame:
    """The state of a recipient is its latest alerts that were let through."""
    exempt = (F.col("priority") == "urgent") | (F.col("category") == "safety")
    rows = alerts.select(F.col("recipient_id").cast("string").alias("key"), MC.micros("created_at").alias("us"), F.col("alert_id").alias("id"), F.coalesce(exempt, F.lit(False)).cast("int").alias("code"))
    held = run_machine(rows, MC.Fatigue(per_hour, per_day), "t2")
    return held.select(F.col("id").alias("alert_id"), F.col("key").cast("bigint").alias("recipient_id"), (F.col("outcome") == 1).alias("suppressed"))


def circuit_states(events: DataFrame, threshold: int = 3, reset_minutes: int = 60) -> DataFrame:
    """Closed -> open after `threshold` consecutive failures; after the
    reset timeout the next event closes it or, if it fails, opens it again.
    A component is the user whose events they are."""
    rows = events.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), MC.micros("ts").alias("us"), F.col("event_id").alias("id"),
                         F.coalesce(F.col("event_type") == "error", F.lit(False)).cast("int").alias("code"))
    found = run_machine(rows, MC.Circuit(threshold, reset_minutes * 60_000_000), "t11")
    return found.select(F.col("key").alias("component"), MC.clock("us").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("outcome") == 1, "open").otherwise("closed").alias("state"))


def daily_upsert(events: DataFrame, table_path: str) -> None:
    """The day sums of each micro-batch, stored under the batch's number
    (a batch that is replayed replaces its own); `daily_totals` adds them."""
    def write(batch: DataFrame, epoch: int) -> None:
        agg = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
            F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
        agg.write.mode("overwrite").parquet(f"{table_path}/batch={epoch}")

    spark = events.sparkSession
    _, ckpt = _paths(spark, "daily_upsert")
    q = events.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def daily_totals(spark: SparkSession, table_path: str) -> DataFrame:
    """The day totals over all stored batches."""
    return spark.read.parquet(table_path).groupBy("day", "event_type").agg(F.sum("events").alias("events"), F.sum("value").alias("value"))
