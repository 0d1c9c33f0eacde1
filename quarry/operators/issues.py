"""Rule-based issue detection (D24), severity (D25), priority tiers (D26),
primary issue (D27), issue unpivot (D38) and breakdown (A53).

Two table-wide statistics (the EDRR fallback test and the priority
quantiles over patients with issues) are one-row aggregates joined back as
a single broadcast row: their size is fixed at one row whatever the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import argmax_name, col_or_lit, num
from quarry.functions.quantiles import exact_quantiles

TYPES = [t[0] for t in config.ISSUE_TYPES]
META = {t[0]: t for t in config.ISSUE_TYPES}


def detect_issues(df: DataFrame) -> DataFrame:
    """issue_<type> (0/1) and count_<type> for 14 types.

    EDRR falls back to `open_issues_edrr` only when the EDRR counts sum to
    zero over the whole table (a one-row aggregate, cross-joined).
    """
    g = lambda name: num(col_or_lit(df, name, 0.0))
    base = df
    if "open_issues_edrr" in df.columns:
        tot = df.agg(F.sum(num(F.col("edrr_edrr_issue_count"))).alias("_edrr_total"))
        base = df.crossJoin(F.broadcast(tot))
        edrr = F.when(F.col("_edrr_total") == 0, g("open_issues_edrr")).otherwise(g("edrr_edrr_issue_count"))
    else:
        edrr = g("edrr_edrr_issue_count")
    gaps = sum((g(c) for c, _ in config.SIGNATURE_GAP_POINTS[1:]), g(config.SIGNATURE_GAP_POINTS[0][0]))
    counts = {
        "sae_dm_pending": g("sae_dm_sae_dm_pending"),
        "sae_safety_pending": F.greatest(g("sae_safety_sae_safety_total") - g("sae_safety_sae_safety_completed"),
                                         F.lit(0.0)),
        "open_queries": g("total_queries"),
        "high_query_volume": g("total_queries"),
        "sdv_incomplete": g("crfs_require_verification_sdv"),
        "signature_gaps": gaps,
        "broken_signatures": g("broken_signatures"),
        "meddra_uncoded": g("meddra_coding_meddra_uncoded"),
        "whodrug_uncoded": g("whodrug_coding_whodrug_uncoded"),
        "missing_visits": g("visit_missing_visit_count"),
        "missing_pages": g("pages_missing_page_count"),
        "lab_issues": g("lab_lab_issue_count"),
        "edrr_issues": edrr,
        "inactivated_forms": g("inactivated_inactivated_form_count"),
    }
    sel = []
    for t in TYPES:
        thr = config.HIGH_QUERY_VOLUME if t == "high_query_volume" else 0
        sel += [(counts[t] > thr).cast("int").alias(f"issue_{t}"), counts[t].alias(f"count_{t}")]
    out = base.select(*df.columns, *sel)
    total = sum((F.col(f"issue_{t}") for t in TYPES[1:]), F.col(f"issue_{TYPES[0]}"))
    return out.select("*", total.alias("total_issues"), (total > 0).cast("int").alias("has_any_issue"))


def severity_scores(df: DataFrame) -> DataFrame:
    """Count x points x criticality, capped at 100, zero unless flagged."""
    g = lambda name: num(col_or_lit(df, name, 0.0))
    sel = []
    for t in TYPES:
        _, _, _, crit, _, _, _, pts = META[t]
        cnt = F.coalesce(F.col(f"count_{t}").cast("double"), F.lit(0.0))
        if t == "high_query_volume":
            sev = F.greatest(cnt - config.HIGH_QUERY_VOLUME, F.lit(0.0)) * pts
        elif t == "signature_gaps":
            sev = None
            for c, p in config.SIGNATURE_GAP_POINTS:
                term = g(c) * F.lit(p)
                sev = term if sev is None else sev + term
        else:
            sev = cnt * F.lit(pts)
        sev = F.least(sev * F.lit(crit), F.lit(100.0)) * F.col(f"issue_{t}")
        sel.append(sev.alias(f"severity_{t}"))
    out = df.select("*", *sel)
    total = sum((F.col(f"severity_{t}") for t in TYPES[1:]), F.col(f"severity_{TYPES[0]}"))
    return out.withColumn("total_severity", total)


def priority_tiers(df: DataFrame) -> DataFrame:
    """Weighted score (cap 100); tiers from quartiles of the score over
    patients with issues (defaults 5/10/25/50 when none); ordered overwrite,
    safety forces critical; SLA days by tier."""
    score = None
    for t in TYPES:
        term = F.col(f"severity_{t}") * F.lit(META[t][6] / 100.0)
        score = term if score is None else score + term
    out = df.withColumn("priority_score", F.least(score, F.lit(100.0)))
    some = out.filter(F.col("total_issues") > 0).select("priority_score")
    cuts = exact_quantiles(some, ["priority_score"], [0.25, 0.5, 0.75, 0.9])["priority_score"]
    out = out.select("*", *[F.lit(d if v is None else v).alias(c) for c, v, d in zip(("_p25", "_p50", "_p75", "_p90"), cuts, (5.0, 10.0, 25.0, 50.0))])
    c = F.col
    safety = (c("issue_sae_dm_pending") == 1) | (c("issue_sae_safety_pending") == 1)
    s = c("priority_score")
    tier = (F.when(c("total_issues") == 0, "none")
            .when(safety | (s >= c("_p90")), "critical")
            .when((s >= c("_p75")) | (c("total_issues") >= 4), "high")
            .when(s >= c("_p50"), "medium")
            .when((s >= c("_p25")) | (c("total_issues") > 0), "low")
            .otherwise("none"))
    sla = F.create_map(*[x for k, v in config.PRIORITY_SLA_DAYS.items() for x in (F.lit(k), F.lit(v))])
    out = out.withColumn("priority_tier", tier).drop("_p25", "_p50", "_p75", "_p90")
    return out.withColumn("sla_days", sla[F.col("priority_tier")])


def primary_issue(df: DataFrame) -> DataFrame:
    """Type with the largest severity (first declared on ties)."""
    sev = [(t, F.col(f"severity_{t}")) for t in TYPES]
    mx = F.greatest(*[v for _, v in sev])
    none = F.col("total_issues") == 0
    return df.select("*", F.when(none, "none").otherwise(argmax_name(sev)).alias("primary_issue"),
                     F.when(none, 0.0).otherwise(mx).alias("primary_issue_severity"))


def issue_pipeline(df: DataFrame) -> DataFrame:
    return primary_issue(priority_tiers(severity_scores(detect_issues(df))))


def issue_rows(df: DataFrame, keys=("patient_key", "study_id", "site_id")) -> DataFrame:
    """One row per (patient, flagged issue) with name, category,
    responsible, count and severity."""
    items = F.array(*[F.when(F.col(f"issue_{t}") == 1, F.struct(
        F.lit(t).alias("issue_type"), F.lit(META[t][1]).alias("issue_name"), F.lit(META[t][2]).alias("category"),
        F.lit(META[t][4]).alias("responsible"), F.lit(META[t][5]).alias("sla_days"),
        F.col(f"count_{t}").cast("double").alias("issue_count"),
        F.col(f"severity_{t}").alias("severity"))) for t in TYPES])
    return df.select(*keys, F.explode(F.array_compact(items)).alias("i")).select(*keys, "i.*")


def issue_breakdown(df: DataFrame) -> DataFrame:
    """Patients per issue type (sum of flags), as rows, largest first."""
    one = df.agg(*[F.sum(F.col(f"issue_{t}")).alias(t) for t in TYPES])
    rows = F.array(*[F.struct(F.lit(t).alias("issue_type"), F.lit(META[t][1]).alias("issue_name"),
                              F.col(t).cast("long").alias("patients")) for t in TYPES])
    return one.select(F.explode(rows).alias("r")).select("r.*")
