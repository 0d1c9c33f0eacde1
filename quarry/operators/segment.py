"""Population segmentation (D15-D18) and the segment summary."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config


def status_category(status: Column) -> Column:
    """Status -> active / completed / terminated / unknown."""
    expr = None
    for cat, statuses in config.STATUS_CATEGORIES:
        cond = status.isin(statuses)
        expr = F.when(cond, cat) if expr is None else expr.when(cond, cat)
    return expr.otherwise(F.lit(None).cast("string"))


def tag_screen_failures(df: DataFrame, status_col: str = "subject_status_clean") -> DataFrame:
    """is_screen_failure, include_in_analysis, exclusion reason."""
    s = F.col(status_col)
    reason = (F.when(s == "Unknown", "Unknown Status").when(s == "Screening", "Still Screening")
              .when(s == "Screen Failure", "Screen Failure"))
    return df.select("*", (s == "Screen Failure").alias("is_screen_failure"),
                     reason.isNull().alias("include_in_analysis"), reason.alias("analysis_exclusion_reason"))


def cohort_flags(df: DataFrame, status_col: str = "subject_status_clean") -> dict[str, Column]:
    s = F.col(status_col)
    extra = {"has_issues": F.col("total_issues_all_sources") > 0,
             "has_sae": F.col("total_sae_issues") > 0}
    return {name: (s.isin(statuses) & extra[flt]) if flt else s.isin(statuses)
            for name, statuses, flt in config.COHORTS}


def assign_cohorts(df: DataFrame, status_col: str = "subject_status_clean") -> DataFrame:
    """Overlapping cohorts as an array (declared order) and the primary
    cohort (highest priority member), 'unassigned' otherwise."""
    flags = cohort_flags(df, status_col)
    members = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    primary = None
    for n in config.COHORT_PRIORITY:
        primary = F.when(flags[n], n) if primary is None else primary.when(flags[n], n)
    return df.select("*", members.alias("cohorts"), primary.otherwise("unassigned").alias("primary_cohort"))


def segment_risk(total: Column) -> Column:
    """Second risk rule, used when a frame has no risk_level."""
    expr = None
    for thr, label in config.SEGMENT_RISK:
        expr = F.when(total >= thr, label) if expr is None else expr.when(total >= thr, label)
    return expr.otherwise("Low")


def with_risk_level(df: DataFrame) -> DataFrame:
    if "risk_level" in df.columns:
        return df
    return df.withColumn("risk_level", segment_risk(F.coalesce(F.col("total_issues_all_sources"), F.lit(0))))


def segment_summary(df: DataFrame, status_col: str = "subject_status_clean") -> DataFrame:
    """Status, category, risk, cohort and lock shares as one table.

    One pass: every patient is exploded into its (segment_type, segment_name)
    memberships, then a single groupBy counts them; the total comes from the
    same pass as a window-free one-row aggregate.
    """
    flags = cohort_flags(df, status_col)
    s = F.col(status_col)
    risk = F.col("risk_level") if "risk_level" in df.columns else \
        segment_risk(F.coalesce(F.col("total_issues_all_sources"), F.lit(0)))
    elig = s.isin(config.LOCK_ELIGIBLE_STATUSES)
    memb = F.array(
        F.struct(F.lit("Status").alias("t"), s.alias("n")),
        *[F.when(s.isin(sts), F.struct(F.lit("Category").alias("t"), F.lit(cat).alias("n")))
          for cat, sts in config.STATUS_CATEGORIES],
        F.when(risk.isin("Critical", "High", "Medium", "Low"), F.struct(F.lit("Risk").alias("t"), risk.alias("n"))),
        *[F.when(c, F.struct(F.lit("Cohort").alias("t"), F.lit(n).alias("n"))) for n, c in flags.items()],
        F.struct(F.lit("DB Lock").alias("t"), F.when(elig, "Eligible").otherwise("Excluded").alias("n")),
    )
    rows = df.select(F.explode(F.array_compact(memb)).alias("m"))
    counts = rows.groupBy(F.col("m.t").alias("segment_type"), F.col("m.n").alias("segment_name")) \
        .agg(F.count(F.lit(1)).alias("patient_count"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return counts.crossJoin(total).select(
        "segment_type", "segment_name", "patient_count",
        F.when(F.col("_n") > 0, F.col("patient_count") * 100.0 / F.col("_n")).otherwise(0.0).alias("pct_of_total"))
