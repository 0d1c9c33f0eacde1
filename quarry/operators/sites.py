"""Site feature matrix, ranks with drivers, and statistics of conversations as
rooms (A22, A63, A64, J11, W17)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.quantiles import exact_quantiles

QUERY_COLUMNS = ("dm_queries", "clinical_queries", "medical_queries", "site_queries", "safety_queries")
OVERDUE_COLUMNS = ("crfs_overdue_for_signs_within_45_days_of_data_entry", "crfs_overdue_for_signs_between_45_to_90_days_of_data_entry", "crfs_overdue_for_signs_beyond_90_days_of_data_entry")


def site_features(record: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per site patients, sum / mean / max / std of every feature, and the
    rates made of the sums: issue and query density, SDV completion, signature
    backlog, pending SAE flag, coding completion, log of the patients.  One
    aggregate; a site of one patient has no std (null)."""
    kinds = {"sum": F.sum, "mean": F.avg, "max": F.max, "std": F.stddev_samp}
    x = record.groupBy("study_id", "site_id").agg(F.count("*").alias("patient_count"), *[f(F.col(c).cast("double")).alias(f"{c}_{k}") for c in features for k, f in kinds.items()])
    total = lambda cols: sum((F.coalesce(F.col(f"{c}_sum"), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(f"{cols[0]}_sum"), F.lit(0.0)))
    over = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(100.0), a / F.when(b == 0, 1.0).otherwise(b) * 100))
    n = F.col("patient_count")
    issues = [c for c in features if "issue" in c]
    return x.select(
        "*", (total(issues) / n).alias("issue_density"), (total(QUERY_COLUMNS) / n).alias("query_density"),
        over(F.col("forms_verified_sum"), F.col("crfs_require_verification_sdv_sum") + F.col("forms_verified_sum")).alias("sdv_completion_rate"),
        (total(OVERDUE_COLUMNS) / F.greatest(F.col("crfs_never_signed_sum"), F.lit(1.0)) * 100).alias("signature_backlog_rate"),
        (total(["sae_dm_sae_dm_pending", "sae_safety_sae_safety_pending"]) > 0).cast("int").alias("has_sae_pending"),
        over(F.col("meddra_coding_meddra_coded_sum"), F.col("meddra_coding_meddra_total_sum")).alias("meddra_completion_rate"), F.log1p(n.cast("double")).alias("log_patient_count"))


def ranked_sites(sites: DataFrame, score: str, top: int = 20) -> DataFrame:
    """The `top` sites by score (ties: study, site) with their rank, up to
    three drivers as text, and half the scores' deviation as a band."""
    q = exact_quantiles(sites, ["issue_density", "query_density"], [0.75])
    band = sites.agg((F.stddev_samp(score) * 0.5).alias("band"))
    drivers = [(F.col("has_sae_pending") > 0, "SAE Pending"), (F.col("issue_density") > F.lit(q["issue_density"][0]), "High Issue Density"),
               (F.col("signature_backlog_rate") > 50, "Signature Backlog"), (F.col("sdv_completion_rate") < 70, "Low SDV"), (F.col("query_density") > F.lit(q["query_density"][0]), "High Query Burden")]
    named = F.slice(F.array_compact(F.array(*[F.when(c, name) for c, name in drivers])), 1, 3)
    best = sites.orderBy(F.desc(score), "study_id", "site_id").limit(top)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc(score), "study_id", "site_id"))  # of the top alone
    return best.crossJoin(F.broadcast(band)).select(
        place.alias("risk_rank"), "study_id", "site_id", F.col(score).alias("risk_score"),
        F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("Multiple Minor Issues").alias("primary_drivers"), F.col("band").alias("confidence_band"), "patient_count")


def site_risk(sites: DataFrame) -> Column:
    """A plain score of a site from its rates."""
    c = F.col
    return c("issue_density") * 10 + c("query_density") * 5 + c("has_sae_pending") * 20 + (100 - c("sdv_completion_rate")) * 0.2 + (100 - c("meddra_completion_rate")) * 0.1


def room_summary(messages: DataFrame) -> DataFrame:
    """(room, messages, members, open_questions, votes, last_turn) of
    each conversation: scalar counts by one grouping and a join of the distinct
    members, no lookup for each room.  A message of the user that ends in ? is
    a question, one of the assistant that begins with yes or no a vote."""
    text = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    x = messages.groupBy(F.col("conv_id").alias("room")).agg(
        F.count("*").alias("messages"), F.count_if((F.col("role") == "user") & text.endswith("?")).alias("questions"),
        F.count_if((F.col("role") == "assistant") & text.rlike("^(yes|no)\\b")).alias("votes"), F.max("turn").alias("last_turn"), F.sum(F.length(text)).alias("chars"))
    members = messages.select(F.col("conv_id").alias("_room"), "role").distinct().groupBy("_room").agg(F.count("role").alias("members"))
    return x.join(members, F.col("room").eqNullSafe(F.col("_room")), "left").drop("_room")


def room_statistics(messages: DataFrame) -> DataFrame:
    """(measure, key, value): rooms, messages and members overall, messages
    by role, and rooms by number of members and by length."""
    rooms = room_summary(messages)
    one = rooms.agg(F.count("*").alias("rooms"), F.sum("messages").alias("messages"), F.max("members").alias("most_members"), F.count_if(F.col("questions") > 0).alias("rooms_with_questions"))
    overall = one.select(F.explode(F.array(*[F.struct(F.lit("overall").alias("measure"), F.lit(c).alias("key"), F.col(c).cast("bigint").alias("value")) for c in one.columns])).alias("r")).select("r.*")
    size = F.when(F.col("messages") <= 2, "short").when(F.col("messages") <= 6, "medium").otherwise("long")
    rows = lambda df, name, key: df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "key", "value")
    return (overall.unionByName(rows(messages, "role", F.coalesce("role", F.lit("none")))).unionByName(rows(rooms, "members", F.col("members"))).unionByName(rows(rooms, "length", size)))
