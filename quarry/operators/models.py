"""Boosted models of risk, issues and resolution time."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranking import histogram_rank
from quarry.operators import boosting as BO
from quarry.operators.ml import leakage_check, stratified_split
from quarry.session import materialize_table

SHORT_DAYS, LONG_DAYS = 7, 30
LEAST_SHORT, LEAST_LONG = 100, 30
QUANTILES = (0.1, 0.5, 0.9)


def risk_classifier(df: DataFrame, key: str, features: Sequence[str], label: str, classes: Sequence[str], target_inputs: Sequence[str], rounds: int = BO.ROUNDS) -> DataFrame:
    """M8: (key, split, label, predicted, p_<class>..): boosted trees with one
    output for each class, fitted on the training part of a stratified split
    (X7); features that the label is made of are refused (M7)."""
    if leak := leakage_check(features, target_inputs):
        raise ValueError(f"the label is made of {leak}")
    x = stratified_split(df.select(key, label, *features), label, F.md5(F.col(key).cast("string")))
    x = materialize_table(x, "risk-split")
    target = lambda c: F.when(F.col("split") == "train", (F.col(label) == c).cast("double"))
    model = BO.boost(x, key, features, [BO.Output(c, target(c), "softmax", group="class") for c in classes], rounds)
    p = BO.predicted(model).select(F.col("id").alias("_id"), BO.shares(F.col("p"), range(len(classes))).alias("s"))
    best = F.array_max(F.transform("s", lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))  # ties: the first class
    out = x.select(F.col(key), "split", F.col(label).alias("label")).join(p, F.col(key).cast("string") == F.col("_id"))
    return out.select(key, "split", "label", F.get(F.array(*map(F.lit, classes)), (-best["i"]).cast("int")).alias("predicted"),
                      *[F.col("s")[k].alias(f"p_{c.lower()}") for k, c in enumerate(classes)])


def issue_classifiers(df: DataFrame, key: str, features: Sequence[str], labels: Sequence[str], held_out: Column, min_prevalence: float = 0.001, rounds: int = BO.ROUNDS) -> DataFrame:
    """M9: (label, prevalence, trained, positives, auc): a boosted classifier for
    every label that is common enough, all fitted in the same passes; the area
    under the ROC curve is that of held-out rows."""
    x = materialize_table(df.select(key, *features, *labels, held_out.alias("_held")), "issue-labels")
    share = x.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in labels]).first()
    common = [c for c in labels if min_prevalence <= (share[c] or 0.0) < 1.0]
    rows = x.sparkSession.createDataFrame([(c, float(share[c] or 0.0), c in common) for c in labels], "label string, prevalence double, trained boolean")
    if not common:
        return rows.withColumn("positives", F.lit(0).cast("long")).withColumn("auc", F.lit(None).cast("double"))
    model = BO.boost(x, key, features, [BO.Output(c, F.when(~F.col("_held"), F.col(c).cast("double")), "logistic") for c in common], rounds)
    p = BO.predicted(model).join(x.where("_held").select(F.col(key).cast("string").alias("id"), F.array(*[F.col(c).cast("int") for c in common]).alias("y")), "id")
    long = p.select(F.posexplode(F.arrays_zip("p", "y")).alias("k", "r")).select(F.get(F.array(*map(F.lit, common)), F.col("k")).alias("label"), F.col("r.p").alias("score"), F.col("r.y").alias("y"))
    ranked = histogram_rank(long, "score", ["label"], prefix="_r")
    auc = ranked.groupBy("label").agg(F.sum("y").alias("positives"), F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, F.col("_r_rank_avg"))).alias("s"))
    pos, neg = F.col("positives"), F.col("n") - F.col("positives")
    auc = auc.select("label", "positives", F.when((pos > 0) & (neg > 0), (F.col("s") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))
    return rows.join(auc, "label", "left").withColumn("positives", F.coalesce("positives", F.lit(0).cast("long")))


def resolution_quantiles(df: DataFrame, key: str, features: Sequence[str], days: str, held_out: Column, rounds: int = BO.ROUNDS) -> DataFrame:
    """(key, days, held_out, slow_probability, p10, p50, p90, confidence) of
    every row: quantiles of all cases, of short and of long ones, blended by
    how likely the case is slow or of medium length, with a least width of the
    interval that grows with that.  Specialists need enough cases."""
    x = materialize_table(df.select(key, *features, F.col(days).cast("double").alias("_days"), held_out.alias("_held")), "resolution-rows")
    y, mine = F.col("_days"), ~F.col("_held")
    short, long, medium = y <= SHORT_DAYS, y > LONG_DAYS, (y > SHORT_DAYS) & (y <= LONG_DAYS)
    n = x.where(mine).agg(F.count_if(short).alias("short"), F.count_if(long).alias("long")).first()
    kinds = {"all": F.lit(True)} | ({"short": short} if n["short"] >= LEAST_SHORT else {}) | ({"long": long} if n["long"] >= LEAST_LONG else {})
    outputs = [BO.Output(f"{k}_{q}", F.when(mine & c, y), "quantile", q) for k, c in kinds.items() for q in QUANTILES]
    outputs += [BO.Output("slow", F.when(mine, long.cast("double")), "logistic"), BO.Output("medium", F.when(mine, medium.cast("double")), "logistic")]
    at = {o.name: i for i, o in enumerate(outputs)}
    p = BO.predicted(BO.boost(x, key, features, outputs, rounds)).withColumnRenamed("id", "_id")
    of = lambda name: F.col("p")[at[name]]
    out = x.join(p, F.col(key).cast("string") == F.col("_id")).withColumns({"slow": BO.chance(of("slow")), "medium": BO.chance(of("medium"))})
    blended = {}
    for q in QUANTILES:
        base = of(f"all_{q}")
        v = F.col("slow") * of(f"long_{q}") + (1 - F.col("slow")) * base if "long" in kinds else base
        w = F.greatest(F.lit(0.0), 1 - F.col("slow") - F.col("medium"))
        blended[f"q{int(q * 100)}"] = w * of(f"short_{q}") + (1 - w) * v if "short" in kinds else w * base + (1 - w) * v
    out = out.withColumns(blended)
    least = 8 + F.col("slow") * 12 + F.col("slow") * (1 - F.col("slow")) * 10
    more = F.greatest(F.lit(0.0), least - (F.col("q90") - F.col("q10")))
    floor = lambda c: F.greatest(F.lit(0.0), c)
    sure = F.when(F.col("slow") < 0.2, "HIGH").when(F.col("slow") < 0.5, "MEDIUM").otherwise("LOW")
    return out.select(key, F.col("_days").alias(days), F.col("_held").alias("held_out"), F.col("slow").alias("slow_probability"), floor(F.col("q10") - more * 0.3).alias("p10"),
                      floor(F.col("q50")).alias("p50"), floor(F.col("q90") + more * 0.7).alias("p90"), sure.alias("confidence"))


def pinball(predicted: DataFrame, days: str, quantiles: dict[str, float]) -> DataFrame:
    """One row: the mean pinball loss of each predicted quantile."""
    loss = lambda c, t: F.avg(F.when(F.col(days) >= F.col(c), (F.col(days) - F.col(c)) * t).otherwise((F.col(c) - F.col(days)) * (1 - t)))
    return predicted.agg(*[loss(c, t).alias(f"pinball_{c}") for c, t in quantiles.items()])
