"""Causal hypotheses: evidence chains, confidence, priority, counters.

A hypothesis is an issue of a patient and a possible root cause, an equi-join of
issue rows with a table of templates (a map in the plan).  Its evidence is an
array of structs on the row, and its confidence a fold over that array: nothing
is shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.exprs import round_half_even

MARGIN = 0.15
LEAST_EVIDENCE = 2


def _array_map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def evidence(kind: Column, count: Column, severity: Column, total: Column, tier: Column) -> Column:
    """What speaks for any cause of an issue: (name, deviation, weight) of
    each piece of evidence that is there."""
    piece = lambda name, deviation, weight: F.struct(F.lit(name).alias("name"), F.lit(deviation).cast("double").alias("deviation") if isinstance(deviation, float) else deviation.cast("double").alias("deviation"),
                                                     F.lit(weight).alias("weight"))
    amount = F.when(count <= 2, 0.3).when(count <= 5, 0.6).otherwise(F.least(count / 10, F.lit(1.0)))
    pieces = [piece("present", 1.0, 0.5), F.when(count > 0, piece("count", amount, 0.8)), F.when(severity > 0, piece("severity", F.least(severity, F.lit(1.0)), 0.7)),
              F.when(total > 1, piece("total", F.least(total / 5, F.lit(0.8)), 0.4)), F.when(tier.isin("critical", "high"), piece("tier", F.when(tier == "critical", 0.9).otherwise(0.7), 0.6))]
    pieces += [F.when((kind == t) & (count > above), piece("special", deviation, weight)) for t, (above, deviation, weight) in config.HYPOTHESIS_SPECIAL_EVIDENCE.items()]
    return F.array_compact(F.array(*pieces))


def confidence(chain: Column) -> Column:
    """Weighted mean of the deviations, more for more evidence (0.04 each,
    0.2 at most), 1 at most."""
    whole = F.aggregate(chain, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
                        lambda a, e: F.struct((a["s"] + e["deviation"] * e["weight"]).alias("s"), (a["w"] + e["weight"]).alias("w")))
    return F.least(whole["s"] / whole["w"] + F.least(F.lit(0.2), F.size(chain) * 0.04), F.lit(1.0))


def priority(kind: Column, sure: Column, base: Column) -> Column:
    """Pending safety issues are high at least; else the template's
    priority, the lower the less sure."""
    return (F.when(kind.isin("sae_dm_pending", "sae_safety_pending"), F.when(sure >= 0.5, "Critical").otherwise("High"))
            .when(sure < 0.3, "Low").when(sure < 0.5, F.when(base.isin("Critical", "High"), "Medium").otherwise("Low"))
            .when((sure < 0.7) & (base == "Critical"), "High").otherwise(base))


def recommendations(kind: Column, cause: Column, sure: Column, first_check: Column) -> Column:
    """Four at most: a check first where the confidence is low, then what
    the issue type and the root cause call for."""
    none = F.expr("CAST(array() AS array<string>)")
    own = F.coalesce(_array_map({t: F.array(*map(F.lit, a)) for t, a in config.HYPOTHESIS_ADVICE.items()})[kind], none)
    by_cause = F.array_compact(F.array(*[F.when(cause.rlike("|".join(words)), text) for words, text in config.HYPOTHESIS_CAUSE_ADVICE]))
    check = F.when(sure < 0.5, F.array(F.concat(F.lit("VERIFY FIRST: "), first_check))).otherwise(none)
    some = F.concat(check, own, by_cause)
    return F.slice(F.when(F.size(some) < 2, F.array_append(some, config.HYPOTHESIS_DEFAULT_ADVICE)).otherwise(some), 1, 4)


def hypotheses(issues: DataFrame) -> DataFrame:
    """A row for each issue (patient_key, study_id, issue_type,
    issue_count, severity, total_issues, priority_tier) and root cause with
    enough evidence."""
    by_type: dict[str, list[Column]] = {}
    for t, cause, base, check in config.HYPOTHESIS_TEMPLATES:
        by_type.setdefault(t, []).append(F.struct(F.lit(cause).alias("root_cause"), F.lit(base).alias("base"), F.lit(check).alias("check")))
    c = F.col
    chain = evidence(c("issue_type"), c("issue_count"), c("severity"), c("total_issues"), c("priority_tier"))
    x = issues.withColumn("evidence", chain).where(F.size("evidence") >= LEAST_EVIDENCE)
    x = x.select("*", F.explode(_array_map({t: F.array(*v) for t, v in by_type.items()})[c("issue_type")]).alias("t")).select("*", "t.*")
    x = x.withColumn("_sure", confidence(c("evidence")))
    margin = MARGIN / F.sqrt(F.size("evidence"))
    sure = round_half_even(c("_sure"), 3)
    return x.select("patient_key", "study_id", "issue_type", "root_cause", "evidence", F.size("evidence").alias("n_evidence"), sure.alias("confidence"),
                    round_half_even(F.greatest(F.lit(0.0), c("_sure") - margin), 3).alias("low"), round_half_even(F.least(F.lit(1.0), c("_sure") + margin), 3).alias("high"),
                    priority(c("issue_type"), sure, c("base")).alias("priority"), recommendations(c("issue_type"), c("root_cause"), sure, c("check")).alias("recommendations"))


def hypothesis_counters(found: DataFrame) -> DataFrame:
    """Hypotheses by issue type, root cause and confidence band."""
    band = F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low")
    return found.groupBy("issue_type", "root_cause", band.alias("band")).agg(F.count("*").alias("hypotheses"), F.count_distinct("patient_key").alias("patients"))


def chain_confidence(pieces: DataFrame, *chain: str) -> DataFrame:
    """For each chain of evidence (strength, supports): the net strength
    scaled to 0..1, its interval and name; a chain without support is worth
    nothing."""
    score = F.coalesce(F.create_map(*[x for k, v in config.EVIDENCE_STRENGTH_SCORES.items() for x in (F.lit(k), F.lit(v))])[F.col("strength")], F.lit(0.0))
    # tenths are summed, so that the order of the rows cannot change the sum
    tenths = F.round(score * 10).cast("long")
    x = pieces.groupBy(*chain).agg(F.count("*").alias("n"), F.sum(F.when(F.col("supports"), tenths).otherwise(0)).alias("_for"), F.sum(F.when(~F.col("supports"), tenths).otherwise(0)).alias("_against"))
    net = (F.col("_for") - F.col("_against")) / 10.0 / F.col("n")
    sure = F.when(F.col("_for") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (net + 1) / 2))).otherwise(0.0)
    margin = MARGIN / F.sqrt("n")
    name = F.when(F.col("confidence") >= 0.8, "strong").when(F.col("confidence") >= 0.6, "moderate").when(F.col("confidence") >= 0.4, "weak").otherwise("inconclusive")
    x = x.withColumn("confidence", sure)
    some = F.col("_for") > 0
    return x.select(*chain, F.col("n").alias("n_evidence"), "confidence", F.when(some, F.greatest(F.lit(0.0), F.col("confidence") - margin)).otherwise(0.0).alias("low"),
                    F.when(some, F.least(F.lit(1.0), F.col("confidence") + margin)).otherwise(0.0).alias("high"), name.alias("strength"))
