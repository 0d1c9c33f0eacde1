"""Unified patient record: spine LEFT JOIN detail aggregates (J1, J4), null
fill by class (P14), derived totals / flags / ratios (P15) and risk label
(P16).  Validation (P17) and the column catalogue (S15) live here too.

All detail aggregates are keyed by the subject key and come out of their
aggregation already hash-partitioned on it, so the chain of left joins adds
no shuffle beyond the spine's own.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import config
from quarry.functions.exprs import clip, safe_ratio
from quarry.sources import testmap

ID_HINTS = ("_id", "key", "_ts", "timestamp")


def left_join_chain(spine: DataFrame, details: Sequence[DataFrame], key: str | list[str]) -> DataFrame:
    """Fold of left joins on the entity key."""
    out = spine
    for d in details:
        out = out.join(d, on=key, how="left")
    return out


def fill_by_class(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Numbers -> 0, status text -> 'Unknown', other text -> '', ids kept.

    Decided by the column *type* (the name-keyword rule of the original
    turned a `country` column numeric because it contains 'count').
    """
    fills: dict = {}
    for f in df.schema.fields:
        name = f.name
        low = name.lower()
        if name in skip or any(h in low for h in ID_HINTS):
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType,
                                   T.ShortType, T.DecimalType)):
            fills[name] = 0
        elif isinstance(f.dataType, T.StringType):
            fills[name] = "Unknown" if "status" in low else ""
    return df.fillna(fills) if fills else df


# Explicit list of issue counts (the original summed every column whose name
# contained missing / pending / issue_count, which also added day columns).
ISSUE_COUNT_COLUMNS = [
    "visit_missing_visit_count",
    "pages_missing_page_count",
    "lab_lab_issue_count",
    "edrr_edrr_issue_count",
    "sae_dm_sae_dm_pending",
    "sae_safety_sae_safety_pending",
]


def risk_level(total: Column) -> Column:
    """0 / <=5 / <=20 / >20 -> Low / Medium / High / Critical."""
    expr = F.when(total == 0, "Low")
    for thr, label in config.RISK_LEVELS[1:]:
        expr = expr.when(total <= thr, label)
    return expr.when(total > config.RISK_LEVELS[-1][0], config.RISK_LEVEL_TOP).otherwise("Unknown")


def derive_metrics(df: DataFrame) -> DataFrame:
    """Totals, coding completion (clip 0-100, 100 when no terms), SAE
    totals, has_* flags and completeness (share of zero factors)."""
    c = F.col
    total_terms = c("meddra_coding_meddra_total") + c("whodrug_coding_whodrug_total")
    coded = c("meddra_coding_meddra_coded") + c("whodrug_coding_whodrug_coded")
    uncoded = c("meddra_coding_meddra_uncoded") + c("whodrug_coding_whodrug_uncoded")
    total_issues = sum((c(x) for x in ISSUE_COUNT_COLUMNS[1:]), c(ISSUE_COUNT_COLUMNS[0]))
    factors = [c("visit_missing_visit_count") == 0, c("pages_missing_page_count") == 0, uncoded == 0]
    completeness = sum((f.cast("double") for f in factors[1:]), factors[0].cast("double")) / len(factors) * 100.0
    return df.select(
        "*",
        total_issues.alias("total_issues_all_sources"),
        total_terms.alias("total_coding_terms"),
        coded.alias("total_coded_terms"),
        uncoded.alias("total_uncoded_terms"),
        F.when(total_terms > 0, clip(coded / total_terms * 100.0, 0.0, 100.0)).otherwise(100.0)
        .alias("coding_completion_rate"),
        (c("sae_dm_sae_dm_total") + c("sae_safety_sae_safety_total")).alias("total_sae_issues"),
        (c("sae_dm_sae_dm_pending") + c("sae_safety_sae_safety_pending")).alias("total_sae_pending"),
        (c("visit_missing_visit_count") > 0).alias("has_missing_visits"),
        (c("pages_missing_page_count") > 0).alias("has_missing_pages"),
        (c("lab_lab_issue_count") > 0).alias("has_lab_issues"),
        (c("edrr_edrr_issue_count") > 0).alias("has_edrr_issues"),
        completeness.alias("completeness_score"),
        risk_level(total_issues).alias("risk_level"),
    )


def build_record(spark: SparkSession, sf_dir: str, as_of: dt.date = config.AS_OF_STAR) -> DataFrame:
    """The wide per-patient record from the driver's tables."""
    sp = testmap.spine(spark, sf_dir)
    details = [testmap.line_counters(spark, sf_dir, as_of),
               testmap.order_counters(spark, sf_dir, as_of),
               testmap.event_counters(spark, sf_dir)]
    rec = left_join_chain(sp, details, "subject_key")
    rec = fill_by_class(rec, skip=["region", "country"])
    return derive_metrics(rec)


def adaptive_key_join(left: DataFrame, detail: DataFrame, full_key: list[str], fallback_key: list[str],
                      threshold: float = 0.5, dedup: bool = True) -> tuple[DataFrame, str]:
    """Choose the join key from the data.

    Match rate = share of detail rows whose full key exists on the left (a
    left-semi join, counted once: one small action before planning).  At or
    above `threshold` join on the full key; otherwise on the fallback key
    with the detail deduplicated on it; if that does not match at all,
    attach the detail columns as nulls.  Returns (frame, strategy).
    """
    value_cols = [c for c in detail.columns if c not in set(full_key) | set(fallback_key)]
    stats = detail.select(*full_key).join(left.select(*full_key).distinct(), full_key, "left_semi") \
        .agg(F.count(F.lit(1)).alias("m"))
    total = detail.agg(F.count(F.lit(1)).alias("n"))
    row = stats.crossJoin(total).first()
    n = row["n"] or 0
    rate = (row["m"] / n) if n else 0.0
    def _prep(key):
        # detail columns that also exist on the left (other than the key) are dropped: the left wins
        return detail.drop(*[c for c in detail.columns if c in left.columns and c not in key])

    if rate >= threshold:
        return left.join(_prep(full_key), full_key, "left"), "full_key"
    fb = _prep(fallback_key)
    if dedup:
        fb = fb.dropDuplicates(fallback_key)
    hit = fb.select(*fallback_key).join(left.select(*fallback_key), fallback_key, "left_semi").limit(1).count()
    if hit:
        return left.join(fb, fallback_key, "left"), "fallback_key"
    out = left
    for cname in value_cols:
        out = out.withColumn(cname, F.lit(None).cast(detail.schema[cname].dataType))
    return out, "none"


def validate_record(df: DataFrame, key: str = "patient_key",
                    required: Sequence[str] = ("patient_key", "study_id", "site_id", "subject_id")) -> DataFrame:
    """One row of checks: rows, duplicate keys, missing required columns."""
    missing = [r for r in required if r not in df.columns]
    dups = df.groupBy(key).count().filter(F.col("count") > 1)
    return (df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(key)).alias("distinct_keys"))
            .crossJoin(dups.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                                F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")))
            .withColumn("missing_required", F.lit(",".join(missing))))


def column_catalogue(df: DataFrame) -> DataFrame:
    """Per column dtype, non-null count and null percentage, from
    one aggregate pass, then unpivoted to one row per column."""
    cols = df.columns
    aggs = [F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(cols)]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col(f"nn_{i}").alias("non_null_count"), F.lit(i).alias("ordinal"))
               for i, c in enumerate(cols)]
    return (one.select("n_rows", F.explode(F.array(*entries)).alias("e"))
            .select("e.column_name", "e.dtype", "e.ordinal", "e.non_null_count",
                    F.when(F.col("n_rows") > 0, (F.col("n_rows") - F.col("e.non_null_count")) * 100.0
                           / F.col("n_rows")).otherwise(0.0).alias("null_pct")))
