"""Data-quality index scorers (D1 basic, D2 enhanced) and bands.

Row-wise expressions only: each scorer is one `select` over the record, so
the plan is a single codegen'd projection with no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import band, clip, col_or_lit, num, round_half_even

COMPONENTS = ["safety", "query", "completeness", "coding", "lab", "sdv", "signature", "edrr"]


def _penalised(issues: Column, k: float) -> Column:
    return F.lit(100.0) - F.least(issues * F.lit(k), F.lit(100.0))


def dqi_component_scores(df: DataFrame) -> dict[str, Column]:
    """D1 components, each 0-100 (100 = no issue)."""
    g = lambda name: num(col_or_lit(df, name, 0.0))  # noqa: E731 - absent column counts as 0
    p = config.DQI_PENALTY
    pending = g("sae_dm_sae_dm_pending") + g("sae_safety_sae_safety_pending")
    q_sum = g("dm_queries") + g("clinical_queries") + g("medical_queries") + g("safety_queries")
    open_q = F.greatest(g("total_queries"), q_sum)
    missing = g("visit_missing_visit_count") + g("pages_missing_page_count")
    if "coding_completion_rate" in df.columns:
        coding = F.coalesce(F.col("coding_completion_rate").cast("double"), F.lit(100.0))
    else:
        coding = _penalised(g("meddra_coding_meddra_uncoded") + g("whodrug_coding_whodrug_uncoded"), 5.0)
    lab = g("lab_lab_issue_count") + g("open_issues_lnr")
    required, verified = g("crfs_require_verification_sdv"), g("forms_verified")
    # A required count that sums to zero over the table means every row is
    # zero (counts are non-negative), which the row rule already maps to 100.
    sdv = F.when(required > 0, clip(verified / required * 100.0, 0.0, 100.0)).otherwise(F.lit(100.0))
    sig = None
    for colname, w in config.SIGNATURE_WEIGHTS.items():
        term = g(colname) * F.lit(w)
        sig = term if sig is None else sig + term
    edrr = F.greatest(g("edrr_edrr_issue_count"), g("open_issues_edrr"))
    return {
        "safety": _penalised(pending, p["safety"]),
        "query": _penalised(open_q, p["query"]),
        "completeness": _penalised(missing, p["completeness"]),
        "coding": coding,
        "lab": _penalised(lab, p["lab"]),
        "sdv": sdv,
        "signature": _penalised(sig, p["signature"]),
        "edrr": _penalised(edrr, p["edrr"]),
    }


def dqi_basic(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """D1 + D3: weighted 8-component DQI, clipped to 0-100, and its band."""
    comps = dqi_component_scores(df)
    raw = [comps[k].alias(f"dqi_{k}_raw") for k in COMPONENTS]
    base = df.select(*(keep or df.columns), *raw)
    weighted = [(F.col(f"dqi_{k}_raw") * F.lit(config.DQI_WEIGHTS[k] / 100.0)).alias(f"dqi_{k}_weighted")
                for k in COMPONENTS]
    base = base.select("*", *weighted)
    total = None
    for k in COMPONENTS:
        total = F.col(f"dqi_{k}_weighted") if total is None else total + F.col(f"dqi_{k}_weighted")
    score = clip(total, 0.0, 100.0)
    return base.select("*", score.alias("dqi_score")).withColumn(
        "dqi_band", band(F.col("dqi_score"), config.DQI_BANDS, config.DQI_BAND_FLOOR))


def age_multiplier(days: Column) -> Column:
    """Completeness age multiplier, half-open day bands."""
    expr = None
    for lo, m in reversed(config.AGE_MULTIPLIERS):
        cond = days >= F.lit(float(lo))
        expr = F.when(cond, F.lit(m)) if expr is None else expr.when(cond, F.lit(m))
    return expr.otherwise(F.lit(1.0))


def dqi_enhanced(df: DataFrame) -> DataFrame:
    """Enhanced DQI with criticality, age multiplier, SDV share and
    signature severity; band + icon; primary issue and worst three
    components; component letter grades."""
    g = lambda name: num(col_or_lit(df, name, 0.0))
    cfg = {name: (w, crit, pen) for name, w, crit, pen in config.ENHANCED_DQI}

    def pen(issues, name, mult=None):
        _, crit, p = cfg[name]
        base = issues * F.lit(p)
        if mult is not None:
            base = base * mult
        base = base * F.lit(crit)
        return clip(F.lit(100.0) - F.least(base, F.lit(100.0)), 0.0, 100.0)

    issues = {
        "safety": g("sae_dm_sae_dm_pending") + g("sae_safety_sae_safety_pending"),
        "query": g("total_queries"),
        "completeness": g("visit_missing_visit_count") + g("pages_missing_page_count"),
        "coding": g("meddra_coding_meddra_uncoded") + g("whodrug_coding_whodrug_uncoded"),
        "lab": g("lab_lab_issue_count") + g("open_issues_lnr"),
        "sdv": g("crfs_require_verification_sdv"),
        "signature": F.when(F.greatest(*[g(c) for c, _ in config.SIGNATURE_SEVERITY]) > 0, 1.0).otherwise(0.0),
        "edrr": F.greatest(g("edrr_edrr_issue_count"), g("open_issues_edrr")),
    }
    required, verified = g("crfs_require_verification_sdv"), g("forms_verified")
    sev = None
    for colname, pts in config.SIGNATURE_SEVERITY:
        t = F.when(g(colname) > 0, F.lit(float(pts))).otherwise(F.lit(0.0))
        sev = t if sev is None else sev + t
    if "coding_completion_rate" in df.columns:
        coding = clip(F.coalesce(F.col("coding_completion_rate").cast("double"), F.lit(100.0)), 0.0, 100.0)
    else:
        coding = pen(issues["coding"], "coding")
    raw = {
        "safety": pen(issues["safety"], "safety"),
        "query": pen(issues["query"], "query"),
        "completeness": pen(issues["completeness"], "completeness",
                            age_multiplier(g("visit_visits_overdue_avg_days"))),
        "coding": coding,
        "lab": pen(issues["lab"], "lab"),
        "sdv": clip(F.when(required + verified > 0, verified / (required + verified) * 100.0)
                    .otherwise(F.lit(100.0)), 0.0, 100.0),
        "signature": clip(F.lit(100.0) - F.least(sev * F.lit(cfg["signature"][1]), F.lit(100.0)), 0.0, 100.0),
        "edrr": pen(issues["edrr"], "edrr"),
    }
    cols = []
    for k in COMPONENTS:
        cols += [raw[k].alias(f"dqi_{k}_raw"), issues[k].alias(f"dqi_{k}_issues")]
    out = df.select("*", *cols)
    weighted = [(F.col(f"dqi_{k}_raw") * F.lit(cfg[k][0] / 100.0)).alias(f"dqi_{k}_weighted") for k in COMPONENTS]
    out = out.select("*", *weighted)
    total = None
    for k in COMPONENTS:
        total = F.col(f"dqi_{k}_weighted") if total is None else total + F.col(f"dqi_{k}_weighted")
    out = out.select("*", clip(total, 0.0, 100.0).alias("dqi_score"))
    score = F.col("dqi_score")
    iss = [(k, F.col(f"dqi_{k}_issues")) for k in COMPONENTS]
    from quarry.functions.exprs import argmax_name, top_n_text
    worst = top_n_text(iss, 3)
    return out.select(
        "*",
        band(score, config.DQI_BANDS, config.DQI_BAND_FLOOR).alias("dqi_band"),
        band(score, config.DQI_ICONS, config.DQI_ICON_FLOOR).alias("dqi_band_icon"),
        argmax_name(iss, min_value=0.0, none_label="none").alias("dqi_primary_issue"),
        F.when(worst == "", "none").otherwise(worst).alias("dqi_worst_components"),
        *[band(F.col(f"dqi_{k}_raw"), config.GRADES, config.GRADE_FLOOR).alias(f"dqi_{k}_grade")
          for k in COMPONENTS],
        F.lit("stable").alias("dqi_trend"),
        F.lit(1.0).alias("dqi_trend_multiplier"),
    )


def dqi_component_summary(scored: DataFrame) -> DataFrame:
    """Per component: patients with issues, total issues, mean / min /
    max raw score and mean weighted contribution (one aggregate pass, then
    unpivot)."""
    aggs = []
    for k in COMPONENTS:
        aggs += [F.count(F.when(F.col(f"dqi_{k}_issues") > 0, 1)).alias(f"{k}__p"),
                 F.sum(F.col(f"dqi_{k}_issues")).alias(f"{k}__t"),
                 F.avg(f"dqi_{k}_raw").alias(f"{k}__avg"), F.min(f"dqi_{k}_raw").alias(f"{k}__min"),
                 F.max(f"dqi_{k}_raw").alias(f"{k}__max"), F.avg(f"dqi_{k}_weighted").alias(f"{k}__c")]
    one = scored.agg(*aggs)
    cfg = {name: (w, crit) for name, w, crit, _ in config.ENHANCED_DQI}
    rows = [F.struct(F.lit(k).alias("component"), F.lit(cfg[k][0]).alias("weight"),
                     F.lit(cfg[k][1]).alias("criticality"), F.col(f"{k}__p").alias("patients_with_issues"),
                     F.col(f"{k}__t").cast("long").alias("total_issues"),
                     round_half_even(F.col(f"{k}__avg"), 2).alias("avg_raw_score"),
                     round_half_even(F.col(f"{k}__min"), 2).alias("min_raw_score"),
                     round_half_even(F.col(f"{k}__max"), 2).alias("max_raw_score"),
                     round_half_even(F.col(f"{k}__c"), 2).alias("contribution")) for k in COMPONENTS]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
