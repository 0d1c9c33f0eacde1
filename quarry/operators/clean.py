"""Clean-patient status: basic two-tier (D6), enhanced tiers with effort
(D7), quick wins (D8) and path to clean (D9).  Row-wise folds only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import first_true, fold_and


def check(df: DataFrame, column: str, condition: str) -> Column:
    """F9 criterion check; an absent column passes."""
    if column not in df.columns:
        return F.lit(True)
    v = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    if condition == "equals_zero":
        return v == 0
    if condition == "equals_100":
        return v >= 100
    if condition == "greater_than_zero":
        return v > 0
    if condition == "is_true":
        return F.coalesce(F.col(column).cast("boolean"), F.lit(False))
    if condition == "is_false":
        return ~F.coalesce(F.col(column).cast("boolean"), F.lit(False))
    return F.lit(True)


def clean_basic(df: DataFrame) -> DataFrame:
    """Tier 1 = 7 zero checks; tier 2 = tier 1 and 7 more; first failing
    criterion per tier; quick-win class (later rules overwrite earlier)."""
    t1 = [(f"tier1_{n}", check(df, c, "equals_zero")) for n, c in config.TIER1_CRITERIA]
    t2 = [(f"tier2_{n}", check(df, c, "equals_zero")) for n, c in config.TIER2_CRITERIA]
    out = df.select("*", *[e.alias(n) for n, e in t1], *[e.alias(n) for n, e in t2])
    c = F.col
    t1_all = fold_and(c(n) for n, _ in t1)
    out = out.select("*", t1_all.alias("tier1_clinical_clean"))
    t2_all = c("tier1_clinical_clean") & fold_and(c(n) for n, _ in t2)
    t1_fail = sum((F.when(~c(n), 1).otherwise(0) for n, _ in t1[1:]), F.when(~c(t1[0][0]), 1).otherwise(0))
    t2_fail = sum((F.when(~c(n), 1).otherwise(0) for n, _ in t2[1:]), F.when(~c(t2[0][0]), 1).otherwise(0))
    out = out.select(
        "*",
        t2_all.alias("tier2_operational_clean"),
        first_true([(~c(f"tier1_{n}"), n) for n, _ in config.TIER1_CRITERIA]).alias("tier1_blocking_reason"),
        F.when(~c("tier1_clinical_clean"), "Not Tier 1 Clean").otherwise(
            first_true([(~c(f"tier2_{n}"), n) for n, _ in config.TIER2_CRITERIA])).alias("tier2_blocking_reason"),
        t1_fail.alias("tier1_failing_count"),
        t2_fail.alias("tier2_failing_count"),
    )
    t1c, t2c = c("tier1_clinical_clean"), c("tier2_operational_clean")
    # ordered overwrite: the last matching rule wins
    qw = (F.when((c("tier1_failing_count") == 2) & ~t1c, "2 Issues to Tier 1")
          .when((c("tier1_failing_count") == 1) & ~t1c, "1 Issue to Tier 1")
          .when(t1c & (c("tier2_failing_count") == 1) & ~t2c, "1 Issue to Tier 2")
          .when(t2c, "Already Clean")
          .otherwise("Not Quick Win"))
    return out.withColumn("quick_win_category", qw)


def _crit_cols(tier: int):
    return [(cid, name, col, hrs, prio, role, act) for t, cid, name, col, hrs, prio, role, act
            in config.CLEAN_CRITERIA if t == tier]


def clean_enhanced(df: DataFrame) -> DataFrame:
    """Per-criterion pass / count / effort, tier flags, effort hours
    and days (8 h day), primary block (lowest priority number, first
    declared on ties), quick-win class and priority, path to clean."""
    c = F.col
    sel = []
    for tier in (1, 2):
        p = f"t{tier}"
        for cid, _, column, hrs, *_ in _crit_cols(tier):
            v = F.coalesce(col_or_lit_d(df, column), F.lit(0.0))
            sel += [(v == 0).alias(f"{p}_{cid}"), v.alias(f"{p}_{cid}_count"),
                    F.when(v == 0, 0.0).otherwise(v * F.lit(hrs)).alias(f"{p}_{cid}_effort_hrs")]
    out = df.select("*", *sel)
    agg_cols = []
    for tier in (1, 2):
        p = f"t{tier}"
        crits = _crit_cols(tier)
        passes = fold_and(c(f"{p}_{cid}") for cid, *_ in crits)
        fails = sum((F.when(~c(f"{p}_{cid}"), 1).otherwise(0) for cid, *_ in crits[1:]),
                    F.when(~c(f"{p}_{crits[0][0]}"), 1).otherwise(0))
        effort = sum((c(f"{p}_{cid}_effort_hrs") for cid, *_ in crits[1:]), c(f"{p}_{crits[0][0]}_effort_hrs"))
        # primary block: min over (priority, ordinal) of failing criteria
        blocks = F.array(*[F.when(~c(f"{p}_{cid}"), F.struct(F.lit(prio).alias("p"), F.lit(i).alias("o"),
                                                              F.lit(cid).alias("id")))
                           for i, (cid, _, _, _, prio, _, _) in enumerate(crits)])
        primary = F.array_min(F.array_compact(blocks))["id"]
        agg_cols += [passes.alias(f"_{p}_pass"), fails.alias(f"tier{tier}_failing_count"),
                     effort.alias(f"tier{tier}_effort_hours"), (effort / 8.0).alias(f"tier{tier}_effort_days"),
                     primary.alias(f"_{p}_primary")]
    out = out.select("*", *agg_cols)
    out = out.select(
        "*", c("_t1_pass").alias("tier1_clean"), (c("_t1_pass") & c("_t2_pass")).alias("tier2_clean"),
        c("_t1_primary").alias("tier1_primary_block"),
        F.when(~c("_t1_pass"), "Not Tier 1 Clean").otherwise(c("_t2_primary")).alias("tier2_primary_block"),
        (c("tier1_effort_hours") + c("tier2_effort_hours")).alias("total_effort_hours"),
    ).drop("_t1_pass", "_t2_pass", "_t1_primary", "_t2_primary")
    out = out.withColumn("total_effort_days", c("total_effort_hours") / 8.0)
    return quick_wins(path_to_clean(out))


def col_or_lit_d(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(0.0)


def quick_wins(df: DataFrame) -> DataFrame:
    """Ordered classes; the low-effort class only for rows no other
    class took (effort in (0, 4] hours)."""
    c = F.col
    t1, t2 = c("tier1_clean"), c("tier2_clean")
    low = (c("total_effort_hours") > 0) & (c("total_effort_hours") <= config.QUICK_WIN_MAX_HOURS)
    cat = (F.when((c("tier1_failing_count") == 2) & ~t1, F.struct(F.lit("2 Issues to Tier 1").alias("c"), F.lit(3).alias("p")))
           .when((c("tier1_failing_count") == 1) & ~t1, F.struct(F.lit("1 Issue to Tier 1").alias("c"), F.lit(2).alias("p")))
           .when(t1 & (c("tier2_failing_count") == 1) & ~t2, F.struct(F.lit("1 Issue to Tier 2").alias("c"), F.lit(1).alias("p")))
           .when(t2, F.struct(F.lit("Already Clean").alias("c"), F.lit(0).alias("p")))
           .when(low, F.struct(F.lit("Low Effort (<4 hrs)").alias("c"), F.lit(4).alias("p")))
           .otherwise(F.struct(F.lit("Not Quick Win").alias("c"), F.lit(999).alias("p"))))
    out = df.withColumn("_qw", cat)
    return out.select("*", c("_qw.c").alias("quick_win_category"), c("_qw.p").alias("quick_win_priority"),
                      (c("_qw.c") != "Not Quick Win").alias("is_quick_win")).drop("_qw")


def path_to_clean(df: DataFrame) -> DataFrame:
    """Failing criteria as actions, tier 1 before tier 2, each by
    priority (declared order on ties); top five as text; next action/role."""
    c = F.col
    items = []
    for i, (tier, cid, name, _, _, prio, role, act) in enumerate(config.CLEAN_CRITERIA):
        items.append(F.when(~c(f"t{tier}_{cid}"), F.struct(
            F.lit(tier).alias("tier"), F.lit(prio).alias("prio"), F.lit(i).alias("o"),
            F.lit(role).alias("role"), F.lit(name).alias("name"), F.lit(act).alias("action"))))
    actions = F.array_sort(F.array_compact(F.array(*items)))
    top = F.slice(actions, 1, 5)
    txt = F.array_join(F.transform(F.col("_acts_top"), lambda a, i: F.concat(
        (i + 1).cast("string"), F.lit(". ["), a["role"], F.lit("] "), a["name"], F.lit(": "), a["action"])), " | ")
    out = df.withColumn("_acts", actions).withColumn("_acts_top", F.slice(F.col("_acts"), 1, 5))
    return out.select(
        "*", F.when(F.size("_acts") == 0, "Clean - No actions needed").otherwise(txt).alias("path_to_clean"),
        F.get(c("_acts"), 0)["action"].alias("next_action"),
        F.get(c("_acts"), 0)["role"].alias("next_responsible")).drop("_acts", "_acts_top")
