"""Per-patient detail aggregates.

Each builder returns a list of aggregate Columns, optionally restricted by a
`where` predicate.  They can be used on their own
(`rows.groupBy(key).agg(*visit_aggs(...))`) or fused: the record builder
evaluates several builders inside ONE `groupBy().agg()` so a large fact
table is scanned and shuffled once, with map-side partial aggregation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import count_where


def _w(where: Column | None) -> Column:
    return where if where is not None else F.lit(True)


def visit_aggs(days: Column, where: Column | None = None) -> list[Column]:
    """A1: missing visits: count, max and mean days outstanding."""
    w = _w(where)
    return [
        count_where(w).alias("visit_missing_visit_count"),
        F.max(F.when(w, days.cast("double"))).alias("visit_visits_overdue_max_days"),
        F.avg(F.when(w, days.cast("double"))).alias("visit_visits_overdue_avg_days"),
    ]


def lab_aggs(where: Column | None = None) -> list[Column]:
    """A2: lab issues per patient."""
    return [count_where(_w(where)).alias("lab_lab_issue_count")]


def sae_aggs(status: Column, kind: str, where: Column | None = None) -> list[Column]:
    """A3: SAE total / pending / completed (status text, case-insensitive)."""
    w = _w(where)
    s = F.lower(F.coalesce(status, F.lit("")))
    p = f"sae_{kind}_sae_{kind}"
    return [
        count_where(w).alias(f"{p}_total"),
        count_where(w & s.contains("pending")).alias(f"{p}_pending"),
        count_where(w & s.rlike("completed|complete")).alias(f"{p}_completed"),
    ]


def inactivated_aggs(form: Column, where: Column | None = None) -> list[Column]:
    """A4: inactivated forms: rows and distinct forms."""
    w = _w(where)
    return [
        count_where(w).alias("inactivated_inactivated_form_count"),
        F.count_distinct(F.when(w, form)).alias("inactivated_inactivated_unique_forms"),
    ]


def pages_aggs(days: Column, where: Column | None = None) -> list[Column]:
    """A5: missing pages: count, max and mean days missing."""
    w = _w(where)
    return [
        count_where(w).alias("pages_missing_page_count"),
        F.max(F.when(w, days.cast("double"))).alias("pages_pages_missing_max_days"),
        F.avg(F.when(w, days.cast("double"))).alias("pages_pages_missing_avg_days"),
    ]


def edrr_aggs(issue_count: Column | None = None, where: Column | None = None) -> list[Column]:
    """EDRR issues: sum of the count column, or one per row."""
    w = _w(where)
    v = issue_count.cast("long") if issue_count is not None else F.lit(1).cast("long")
    return [F.coalesce(F.sum(F.when(w, v)), F.lit(0).cast("long")).alias("edrr_edrr_issue_count")]


UNCODED_PATTERN = "uncoded|un-coded|not coded"


def coding_aggs(status: Column, dictionary: str, where: Column | None = None) -> list[Column]:
    """Coding totals; 'coded' excludes the uncoded spellings."""
    w = _w(where)
    s = F.lower(F.coalesce(status, F.lit("")))
    uncoded = s.rlike(UNCODED_PATTERN)
    coded = s.contains("coded") & ~uncoded
    p = f"{dictionary}_coding_{dictionary}"
    return [
        count_where(w).alias(f"{p}_total"),
        count_where(w & coded).alias(f"{p}_coded"),
        count_where(w & uncoded).alias(f"{p}_uncoded"),
    ]


def aggregate_detail(rows: DataFrame, key: str | list[str], aggs: list[Column]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(*aggs)
