"""Database-lock readiness: basic status and effort (D14), eligibility
(D10), 13 criteria and tiers (D11), blockers (D12), days to ready (D13)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import col_or_lit, num, round_half_even


def lock_basic(df: DataFrame, status_col: str = "subject_status_clean") -> DataFrame:
    """D14 on top of `clean_basic` output."""
    c = F.col
    eligible = c(status_col).isin(config.LOCK_ELIGIBLE_STATUSES)
    pending = (num(col_or_lit(df, "sae_dm_sae_dm_pending")) > 0) | \
        (num(col_or_lit(df, "sae_safety_sae_safety_pending")) > 0) | \
        (num(col_or_lit(df, "crfs_never_signed")) > 0)
    t2 = F.coalesce(c("tier2_operational_clean"), F.lit(False)) if "tier2_operational_clean" in df.columns \
        else F.lit(True)
    t1 = F.coalesce(c("tier1_clinical_clean"), F.lit(False)) if "tier1_clinical_clean" in df.columns \
        else F.lit(True)
    ready = eligible & t2 & ~pending
    out = df.select("*", ready.alias("db_lock_tier1_ready"),
                    (eligible & t1 & ~ready).alias("db_lock_tier2_pending"),
                    (eligible & ~t1).alias("db_lock_not_ready"),
                    eligible.alias("db_lock_eligible"))
    status = (F.when(c("db_lock_tier1_ready"), "Tier 1 - Ready")
              .when(c("db_lock_tier2_pending"), "Tier 2 - Pending")
              .when(c("db_lock_eligible"), "Not Ready").otherwise("Not Eligible"))
    effort = num(col_or_lit(df, "tier1_failing_count")) * 2 + num(col_or_lit(df, "tier2_failing_count"))
    return out.select("*", status.alias("db_lock_status"), effort.alias("db_lock_effort_score"))


def lock_enhanced(df: DataFrame, status_col: str = "subject_status_clean") -> DataFrame:
    """Eligibility and exclusion reason, 13 criteria, readiness
    tiers (all pass / critical+high pass), status, blockers ordered by
    severity (declared order within a severity), days to ready."""
    c = F.col
    st = c(status_col)
    sel = [st.isin(config.LOCK_ELIGIBLE_STATUSES).alias("dblock_eligible"),
           F.when(st.isin(config.LOCK_EXCLUDED_STATUSES), st).alias("dblock_exclusion_reason")]
    for cid, _, column, *_ in config.LOCK_CRITERIA:
        v = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) if column in df.columns else F.lit(0.0)
        sel += [(v == 0).alias(f"dblock_{cid}"), v.alias(f"dblock_{cid}_count")]
    out = df.select("*", *sel)
    elig = c("dblock_eligible")
    all_pass = elig
    crit_high = elig
    for cid, _, _, sev, rank, *_ in config.LOCK_CRITERIA:
        all_pass = all_pass & c(f"dblock_{cid}")
        if rank <= 2:
            crit_high = crit_high & c(f"dblock_{cid}")
    out = out.select("*", all_pass.alias("dblock_tier1_ready"),
                     (crit_high & ~all_pass).alias("dblock_tier2_pending"))
    out = out.withColumn("dblock_not_ready", elig & ~c("dblock_tier1_ready") & ~c("dblock_tier2_pending"))
    status = (F.when(~elig, "Not Eligible").when(c("dblock_tier1_ready"), "Ready")
              .when(c("dblock_tier2_pending"), "Pending").otherwise("Blocked"))
    blockers = F.array_sort(F.array_compact(F.array(*[
        F.when(~c(f"dblock_{cid}"), F.struct(F.lit(rank).alias("r"), F.lit(i).alias("o"), F.lit(cid).alias("id"),
                                              F.lit(name).alias("name"), F.lit(sev).alias("sev")))
        for i, (cid, name, _, sev, rank, _, _) in enumerate(config.LOCK_CRITERIA)])))
    out = out.select("*", status.alias("dblock_status"), blockers.alias("_b"))
    first5 = F.transform(F.slice(c("_b"), 1, 5),
                         lambda b: F.concat(F.lit("["), F.substring(b["sev"], 1, 1), F.lit("] "), b["name"]))
    # days to ready: per failing criterion, count capped to [1, 100]; up to
    # five issues at full days, the rest at half; <= 30 each; x buffer; <= 90
    terms = []
    for cid, _, _, _, _, rd, _ in config.LOCK_CRITERIA:
        n = F.greatest(F.lit(1.0), F.least(c(f"dblock_{cid}_count"), F.lit(100.0)))
        d = F.when(n <= 5, n * rd).otherwise(F.lit(rd * 5) + F.lit(rd * 0.5) * (n - 5))
        terms.append(F.when(~c(f"dblock_{cid}"), F.least(d, F.lit(30.0))).otherwise(F.lit(0.0)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    days = (F.when(c("dblock_tier1_ready"), F.lit(0.0))
            .when(~elig, F.lit(None).cast("double"))
            # exact decimal arithmetic: the terms are multiples of 0.125, so the
            # one-decimal rounding of a binary double would sit on ties
            .otherwise(F.bround(F.least(total.cast("decimal(24,6)") * F.lit(config.LOCK_ESTIMATION_BUFFER).cast("decimal(6,3)"),
                                        F.lit(90).cast("decimal(24,6)")), 1).cast("double")))
    out = out.select(
        "*",
        F.get(c("_b"), 0)["id"].alias("dblock_primary_blocker"),
        F.get(c("_b"), 0)["name"].alias("dblock_primary_blocker_name"),
        F.size(c("_b")).alias("dblock_blocker_count"),
        F.size(F.filter(c("_b"), lambda b: b["sev"] == "Critical")).alias("dblock_critical_count"),
        F.when(F.size(c("_b")) == 0, "None").otherwise(F.array_join(first5, "; ")).alias("dblock_blockers_list"),
        days.alias("dblock_days_to_ready"),
    ).drop("_b")
    dd = c("dblock_days_to_ready")
    cat = F.when(dd.isNull(), "Not Eligible").when(dd == 0, "Ready Now")
    for thr, label in config.LOCK_DAYS_CATEGORIES[1:]:
        cat = cat.when(dd <= thr, label)
    return out.withColumn("dblock_days_category", cat.otherwise(">4 Weeks"))
