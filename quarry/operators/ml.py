"""Feature engineering, evaluation and models (M1, M4, M8, M14, M16, M18,
M20, M22, M23, M25, M26, M28, M29, X6, X7).

Statistics are aggregates (map-side combined); ranks go through value
histograms or range-partitioned row numbers; nothing is collected but
one-row results.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.quantiles import exact_quantiles
from quarry.functions.ranking import histogram_rank, running_sums
from quarry.session import materialize_table


def ordered_row_number(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str = "row_number") -> DataFrame:
    """Row number within groups by `order`, without one task per group.

    Rows are range-partitioned on (groups, order) and written once with the
    number of their range; rows and counts are then read from the same
    files, so both see the same ranges.  Each range numbers its rows per
    group, the counts of the ranges before it give the offset.
    """
    g, o = list(groups), list(order)
    x = materialize_table(df.repartitionByRange(*g, *o).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = x.groupBy("_p", *g).agg(F.count(F.lit(1)).alias("_c")).select(
        "_p", *g, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    x = x.withColumn("_lr", F.row_number().over(Window.partitionBy("_p", *g).orderBy(*o)))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ["_p", *g]]
    return (x.alias("x").join(offsets.alias("n"), same)
            .select(*[F.col(f"x.`{c}`") for c in df.columns], (F.col("_off") + F.col("_lr")).cast("long").alias(out)))


def stratified_split(df: DataFrame, label: str, key: Column, fractions=(0.6, 0.2)) -> DataFrame:
    """Per class, rows ordered by a hash of the key; the first 60 % train,
    next 20 % validation, rest test (floor of the cumulative share)."""
    x = df.withColumn("_h", key)
    x = ordered_row_number(x, [label], ["_h"], "_rn")
    n = x.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(F.broadcast(n), label)
    a, b = fractions
    split = F.when(F.col("_rn") <= F.floor(F.col("_n") * a), "train") \
        .when(F.col("_rn") <= F.floor(F.col("_n") * (a + b)), "validation").otherwise("test")
    return x.withColumn("split", split).drop("_h", "_rn", "_n")


def variance_screen(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """M1: variance and distinct count of each numeric feature in one pass;
    constant or low-variance features are flagged for dropping."""
    aggs = []
    for c in cols:
        aggs += [F.var_samp(F.col(c).cast("double")).alias(f"{c}__v"), F.count_distinct(c).alias(f"{c}__d")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__v").alias("variance"),
                              F.col(f"{c}__d").alias("distinct_values")) for c in cols])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    return r.withColumn("drop", (F.col("distinct_values") <= 1) | (F.coalesce(F.col("variance"), F.lit(0.0)) < threshold))


def robust_scale(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """M4: (x - median) / IQR per column; IQR 0 -> 1."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    out = []
    for c in cols:
        low, mid, high = (F.lit(x).cast("double") for x in q[c])
        iqr = high - low
        out.append(((F.col(c).cast("double") - mid) / F.when(iqr == 0, 1.0).otherwise(iqr)).alias(f"{c}_scaled"))
    return df.select(*keys, *out)


def zscore_drivers(df: DataFrame, keys: Sequence[str], cols: Sequence[str], z: float = 2.0, top: int = 3) -> DataFrame:
    """Per-row z-scores against the table, the top three features with
    z > 2 as 'name (z=..)' text and the largest z."""
    st = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_samp(c).alias(f"{c}__s") for c in cols])
    x = df.crossJoin(F.broadcast(st))
    zs = {c: F.when(F.col(f"{c}__s") > 0, (F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__s")).otherwise(0.0) for c in cols}
    arr = F.array(*[F.struct((-zs[c]).alias("k"), F.lit(i).alias("o"), F.lit(c).alias("n"), zs[c].alias("z"))
                    for i, c in enumerate(cols)])
    hi = F.slice(F.filter(F.array_sort(arr), lambda s: s["z"] > z), 1, top)
    txt = F.array_join(F.transform(hi, lambda s: F.concat(s["n"], F.lit(" (z="), F.format_number(s["z"], 2), F.lit(")"))), ", ")
    return x.select(*keys, F.greatest(*[zs[c] for c in cols]).alias("max_z"), txt.alias("top_drivers"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Confusion counts."""
    return df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro and
    weighted averages (rows 'macro avg', 'weighted avg')."""
    cm = confusion(df, label, pred)
    tp = cm.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("predicted"))
    r = sup.join(prd, "cls", "full").join(tp, "cls", "left").fillna(0, ["support", "predicted", "tp"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rc = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    r = r.select("cls", "support", p.alias("precision"), rc.alias("recall"))
    r = r.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                                  / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    tot = r.agg(F.sum("support").alias("_n"), F.count(F.lit(1)).alias("_k"))
    macro = r.agg(F.lit("macro avg").alias("cls"), F.sum("support").alias("support"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    wavg = r.crossJoin(tot).agg(F.lit("weighted avg").alias("cls"), F.sum("support").alias("support"),
                                *[(F.sum(F.col(m) * F.col("support")) / F.max("_n")).alias(m) for m in ("precision", "recall", "f1")])
    return r.select("cls", "support", "precision", "recall", "f1").unionByName(macro).unionByName(wavg)


def ordinal_errors(df: DataFrame, label: str, pred: str, order: Sequence[str], critical: str) -> DataFrame:
    """Mean absolute tier distance, critical-miss rate (critical
    predicted lower), cost-weighted error (under-prediction x2)."""
    pos = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    d = pos[F.col(pred)] - pos[F.col(label)]
    return df.agg(F.avg(F.abs(d)).alias("ordinal_mae"),
                   F.avg(F.when(F.col(label) == critical, (F.col(pred) != critical).cast("double"))).alias("critical_miss_rate"),
                   F.avg(F.when(d < 0, -d * 2.0).otherwise(d.cast("double"))).alias("cost_weighted_error"),
                   F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Count, prevalence and balanced class weight n / (k x count)."""
    c = df.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("count"))
    t = c.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(t).select("cls", "count", (F.col("count") / F.col("_n")).alias("prevalence"),
                                 (F.col("_n") / (F.col("_k") * F.col("count"))).alias("class_weight"))


def threshold_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Precision, recall and F1 at every distinct score used as the threshold
    (score >= t), from the histogram of scores summed range by range."""
    h = df.groupBy(F.col(score).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(positive.cast("long")).alias("pos"))
    h = running_sums(h.withColumn("_down", -F.col("t")), ["_down"], ["n", "pos"])
    h = h.crossJoin(h.agg(F.sum("pos").alias("_P"))).withColumns({"predicted_pos": F.col("n_before") + F.col("n"), "tp": F.col("pos_before") + F.col("pos")})
    prec = F.col("tp") / F.col("predicted_pos")
    rec = F.when(F.col("_P") > 0, F.col("tp") / F.col("_P")).otherwise(0.0)
    h = h.select("t", prec.alias("precision"), rec.alias("recall"))
    return h.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def best_f1_threshold(df: DataFrame, score: str, positive: Column, min_recall: float = 0.0) -> DataFrame:
    """The threshold of best F1 among those whose recall reaches
    `min_recall` (ties: lower t); no row if none does."""
    h = threshold_curve(df, score, positive).where(F.col("recall") >= min_recall)
    return h.orderBy(F.col("f1").desc(), F.col("t").asc()).limit(1).withColumnRenamed("t", "threshold")


def ranking_metrics(df: DataFrame, item: str, pred: str, truth: str, ks=(5, 10, 20)) -> DataFrame:
    """NDCG@k (relevance = truth, ranking by pred; ties by item) and
    Spearman (correlation of average ranks)."""
    r = histogram_rank(histogram_rank(df.select(item, pred, truth), pred, prefix="_rp"), truth, prefix="_rt")
    sp = r.agg(F.corr("_rp_rank_avg", "_rt_rank_avg").alias("spearman"))
    out = sp
    for k in ks:
        top_p = df.orderBy(F.col(pred).desc(), F.col(item).asc()).limit(k)
        top_t = df.orderBy(F.col(truth).desc(), F.col(item).asc()).limit(k)
        wp = Window.orderBy(F.col(pred).desc(), F.col(item).asc())
        wt = Window.orderBy(F.col(truth).desc(), F.col(item).asc())
        dcg = top_p.select((F.col(truth) / F.log2(F.row_number().over(wp) + 1.0)).alias("g")).agg(F.sum("g").alias("d"))
        idcg = top_t.select((F.col(truth) / F.log2(F.row_number().over(wt) + 1.0)).alias("g")).agg(F.sum("g").alias("i"))
        out = out.crossJoin(dcg.crossJoin(idcg).select(
            F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(0.0).alias(f"ndcg_at_{k}")))
    return out


def context_features(df: DataFrame) -> DataFrame:
    """Patients per site, study mean / std of missing pages, ratio to
    the study mean, large / small site by the quartiles of site size."""
    site = df.groupBy("study_id", "site_id").agg(F.count(F.lit(1)).alias("site_patients"))
    study = df.groupBy("study_id").agg(F.avg("pages_missing_page_count").alias("study_pages_mean"),
                                       F.stddev_samp("pages_missing_page_count").alias("study_pages_std"))
    q = site.agg(F.percentile("site_patients", [0.25, 0.75]).alias("_q"))
    x = df.join(site, ["study_id", "site_id"]).join(study, "study_id").crossJoin(F.broadcast(q))
    return x.select("patient_key", "site_patients", "study_pages_mean", "study_pages_std",
                    F.when(F.col("study_pages_mean") > 0, F.col("pages_missing_page_count") / F.col("study_pages_mean"))
                    .otherwise(0.0).alias("pages_ratio_to_study"),
                    (F.col("site_patients") >= F.col("_q")[1]).alias("large_site"),
                    (F.col("site_patients") <= F.col("_q")[0]).alias("small_site"))


def low_prevalence(issues: DataFrame, types: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Per issue label prevalence, count and a below-1 % flag."""
    one = issues.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"issue_{t}").alias(t) for t in types])
    rows = F.array(*[F.struct(F.lit(t).alias("issue_type"), F.col(t).cast("long").alias("positives")) for t in types])
    r = one.select("_n", F.explode(rows).alias("r")).select("_n", "r.*")
    return r.select("issue_type", "positives", (F.col("positives") / F.col("_n")).alias("prevalence"),
                    (F.col("positives") / F.col("_n") < threshold).alias("below_threshold"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of n rows: order by md5(key || seed) and take
    n (the sample is the feature; TakeOrderedAndProject keeps n per task)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def kfold(df: DataFrame, label: str, key: Column, k: int = 5) -> DataFrame:
    """Stratified fold id = (row number within class by hash) mod k."""
    x = ordered_row_number(df.withColumn("_h", key), [label], ["_h"], "_rn")
    return x.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn")


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M2: Pearson correlation of every feature pair in one aggregate (null
    when a feature is constant)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ok = (F.var_samp(F.col(a).cast("double")) > 0) & (F.var_samp(F.col(b).cast("double")) > 0)
        aggs.append(F.when(ok, F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias(f"p{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def correlation_drop_list(pairs: DataFrame, cols: Sequence[str], threshold: float) -> list[str]:
    """M2: for each feature in order, drop earlier kept features correlated
    above the threshold.  Runs on the k x k table (k features), on the driver."""
    high = {(r.feature_a, r.feature_b) for r in pairs.filter(F.abs(F.col("r")) > threshold).collect()}
    kept: list[str] = []
    dropped: list[str] = []
    for c in cols:
        for k in list(kept):
            if (k, c) in high or (c, k) in high:
                kept.remove(k)
                dropped.append(k)
        kept.append(c)
    return dropped


def platt_calibration(df: DataFrame, score: str, label: Column) -> DataFrame:
    """Sigmoid (Platt) calibration of a score by logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=[score], outputCol="_f").transform(df.withColumn("_y", label.cast("double")))
    model = LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=50).fit(x)
    return model.transform(x).withColumn("calibrated", vector_to_array("probability")[1]).drop("_f", "_y", "rawPrediction",
                                                                                              "probability", "prediction")


def _minmax(c: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, F.lit(0.5)).otherwise((c - lo) / (hi - lo))


def baseline_ranker(site: DataFrame, weights=None) -> DataFrame:
    """Rule risk score = .30 issue density + .25 signature backlog rate
    + .25 SAE pending flag + .20 (100 - SDV completion), each numeric term
    min-max normalised over sites (0.5 when constant); rank 1 = riskiest."""
    w = weights or {"issue_density": 0.30, "signature_backlog_rate": 0.25, "has_sae_pending": 0.25, "inverse_sdv": 0.20}
    x = site.withColumn("inverse_sdv", F.lit(100.0) - F.coalesce(F.col("sdv_completion_rate"), F.lit(100.0)))
    cols = ["issue_density", "signature_backlog_rate", "inverse_sdv"]
    st = x.agg(*[F.min(c).alias(f"{c}__lo") for c in cols], *[F.max(c).alias(f"{c}__hi") for c in cols])
    x = x.crossJoin(F.broadcast(st))
    score = (F.lit(w["issue_density"]) * _minmax(F.col("issue_density"), F.col("issue_density__lo"), F.col("issue_density__hi"))
             + F.lit(w["signature_backlog_rate"]) * _minmax(F.col("signature_backlog_rate"), F.col("signature_backlog_rate__lo"),
                                                           F.col("signature_backlog_rate__hi"))
             + F.lit(w["has_sae_pending"]) * F.col("has_sae_pending").cast("double")
             + F.lit(w["inverse_sdv"]) * _minmax(F.col("inverse_sdv"), F.col("inverse_sdv__lo"), F.col("inverse_sdv__hi")))
    x = x.select(*site.columns, score.alias("baseline_score"))
    return histogram_rank(x, "baseline_score", ascending=False, prefix="_r").withColumnRenamed("_r_rank_min", "risk_rank") \
        .drop("_r_rank_avg", "_r_pct")


def risk_target(df: DataFrame) -> DataFrame:
    """M5: outcome-based risk score (weighted indicator terms) cut at its
    p50 / p80 / p95 into Low / Medium / High / Critical (right-closed bins)."""
    from quarry import config
    c = F.col
    calc = {"sae_dm_pending_calc": F.greatest(c("sae_dm_sae_dm_total") - c("sae_dm_sae_dm_completed"), F.lit(0)),
            "sae_safety_pending_calc": F.greatest(c("sae_safety_sae_safety_total") - c("sae_safety_sae_safety_completed"), F.lit(0)),
            "meddra_uncoded_calc": F.greatest(c("meddra_coding_meddra_total") - c("meddra_coding_meddra_coded"), F.lit(0))}
    score = F.lit(0.0)
    for col, thr, pts in config.RISK_TARGET_TERMS:
        v = calc.get(col, F.coalesce(c(col), F.lit(0)))
        score = score + F.when(v > thr, F.lit(pts)).otherwise(F.lit(0.0))
    x = df.withColumn("risk_score", score)
    q = x.agg(F.percentile("risk_score", [0.5, 0.8, 0.95]).alias("_q"))
    x = x.crossJoin(F.broadcast(q))
    s = c("risk_score")
    lvl = F.when(s <= c("_q")[0], "Low").when(s <= c("_q")[1], "Medium").when(s <= c("_q")[2], "High").otherwise("Critical")
    return x.withColumn("risk_target", lvl).drop("_q")


def red_flags(metrics: DataFrame) -> DataFrame:
    """Leakage (NDCG@k above 0.95) and not-learning (NDCG@10 below
    0.55) flags over a one-row ranking-metric frame."""
    from quarry import config
    c = F.col
    rules = [F.when(c(f"ndcg_at_{k}") > config.MAX_ACCEPTABLE_NDCG, F.struct(
        F.lit("LEAKAGE").alias("type"), F.lit("CRITICAL").alias("severity"), F.lit(f"ndcg@{k}").alias("metric"),
        c(f"ndcg_at_{k}").alias("value"), F.lit(config.MAX_ACCEPTABLE_NDCG).alias("threshold"))) for k in (5, 10, 20)]
    rules.append(F.when(c("ndcg_at_10") < config.MIN_ACCEPTABLE_NDCG, F.struct(
        F.lit("NOT_LEARNING").alias("type"), F.lit("WARNING").alias("severity"), F.lit("ndcg@10").alias("metric"),
        c("ndcg_at_10").alias("value"), F.lit(config.MIN_ACCEPTABLE_NDCG).alias("threshold"))))
    return metrics.select(F.explode(F.array_compact(F.array(*rules))).alias("f")).select("f.*")


def leakage_check(features: Sequence[str], target_inputs: Sequence[str]) -> list[str]:
    """Features that are also inputs of the target definition (a
    plan-time check on column lists; an empty list means no leakage)."""
    inputs = set(target_inputs)
    return [f for f in features if f in inputs]
