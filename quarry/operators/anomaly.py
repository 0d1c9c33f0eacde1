"""Anomaly scores: isolation forest, its ensembles, and their site rollup
(M21, M22, A19, A20, W11).

The forest's trees are grown together, a level at a time: one aggregate over
(tree, node) gives each node's size and the range of every feature, and the
split is drawn from hashes of (seed, tree, node), so a rerun gives the same
trees.  A tree sees `SAMPLE` rows, as the method has it: the trees' rows are
those of least hash, dealt out.  Every row is scored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.quantiles import exact_quantiles
from quarry.functions.ranking import histogram_rank
from quarry.operators.ml import robust_scale
from quarry.operators.neighbors import outlier_factors
from quarry.session import materialize_table

TREES, SAMPLE, FEATURE_SHARE = 200, 256, 0.8
WEIGHTS = {"forest": 0.4, "lof": 0.3, "residual": 0.3}
LITE_WEIGHTS = {"forest": 0.5, "residual": 0.3, "zscore": 0.2}
SEVERITIES = {"Critical": 0.99, "High": 0.95, "Medium": 0.90}
NEIGHBORS = 20


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    out = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """feature (-1 at a leaf), threshold and size by (tree, node); node 1 is the
    root, node i has the children 2 i and 2 i + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    size: np.ndarray
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, steps = np.arange(len(self.feature))[None, :], int(np.log2(self.feature.shape[1])) - 1
        node, depth = np.ones((len(x), len(self.feature)), np.int64), np.zeros((len(x), len(self.feature)))
        rows = np.arange(len(x))[:, None]
        for _ in range(steps):
            f = self.feature[trees, node]
            inner = f >= 0
            node = np.where(inner, 2 * node + (x[rows, np.maximum(f, 0)] >= self.threshold[trees, node]), node)
            depth += inner
        path = depth + average_path(self.size[trees, node])
        return 2.0 ** (-path.mean(axis=1) / max(float(average_path(self.sample)), 1e-9))


def _unit(seed: int, what: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), "tree", "node", F.lit(what)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)


def grow_forest(df: DataFrame, key: str, vec: str, dims: int, trees: int = TREES, sample: int = SAMPLE, share: float = FEATURE_SHARE, seed: int = 42) -> Forest:
    """A forest over rows (key, vec array<double>)."""
    levels = int(np.ceil(np.log2(max(2, sample))))
    allowed = max(1, int(share * dims))
    # trees * sample rows at most
    pool = df.select(F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("_h"), F.col(key).cast("string").alias("_k"), F.col(vec).alias("f")).orderBy("_h", "_k").limit(trees * sample)
    pool = materialize_table(pool, "forest-pool")
    n = pool.count()
    if not n:
        return Forest(np.full((1, 4), -1), np.zeros((1, 4)), np.zeros((1, 4)), 0)
    spark, per = df.sparkSession, min(sample, n)
    if n >= trees * sample:  # each row in one tree
        nth = F.row_number().over(Window.orderBy("_h", "_k"))  # of the pool alone
        rows = pool.withColumn("tree", ((nth - 1) % trees).cast("int"))
    else:  # few rows: each tree takes those whose hash with its number is least
        dealt = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        nth = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("_h", "_k", "tree"), "_k"))
        rows = dealt.withColumn("_n", nth).where(F.col("_n") <= per)
    rng = np.random.default_rng(seed)
    picks = [(t, sorted(rng.permutation(dims)[:allowed].tolist())) for t in range(trees)]
    of_tree = F.broadcast(spark.createDataFrame(picks, "tree int, allowed array<int>"))
    rows = materialize_table(rows.select("tree", F.lit(1).cast("long").alias("node"), "f"), "forest-rows")
    size = 1 << (levels + 1)
    feature, threshold, count = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for level in range(levels + 1):
        ranges = F.array(*[F.struct(F.min(F.col("f")[i]).alias("lo"), F.max(F.col("f")[i]).alias("hi")) for i in range(dims)])
        nodes = rows.groupBy("tree", "node").agg(F.count("*").alias("n"), ranges.alias("ranges")).join(of_tree, "tree")
        open_ = F.filter("allowed", lambda i: F.get("ranges", i)["lo"] < F.get("ranges", i)["hi"])
        nodes = nodes.withColumn("open", F.when(F.col("n") > 1, open_).otherwise(F.expr("CAST(array() AS array<int>)")) if level < levels else F.expr("CAST(array() AS array<int>)"))
        nodes = nodes.withColumn("feature", F.get("open", F.floor(_unit(seed, "feature") * F.size("open")).cast("int")))
        at = F.get("ranges", F.col("feature"))
        nodes = materialize_table(nodes.select("tree", "node", "n", "feature", (at["lo"] + _unit(seed, "threshold") * (at["hi"] - at["lo"])).alias("threshold")), "forest-nodes")
        got = nodes.collect()  # trees * 2^level at most
        for r in got:
            count[r["tree"], r["node"]] = r["n"]
            if r["feature"] is not None:
                feature[r["tree"], r["node"]], threshold[r["tree"], r["node"]] = r["feature"], r["threshold"]
        if all(r["feature"] is None for r in got):
            break
        rows = rows.join(F.broadcast(nodes.where("feature IS NOT NULL").drop("n")), ["tree", "node"])
        rows = materialize_table(rows.select("tree", (F.col("node") * 2 + (F.get("f", F.col("feature")) >= F.col("threshold")).cast("long")).alias("node"), "f"), "forest-rows")
    return Forest(feature, threshold, count, per)


def forest_scores(df: DataFrame, vec: str, forest: Forest, to: str = "forest_score") -> DataFrame:
    """Add the score 2 ** (-mean path / average path): near 1 for rows that few
    splits set apart."""
    sent = df.sparkSession.sparkContext.broadcast(forest)
    names = df.columns

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = np.array(part.column(names.index(vec)).to_pylist(), float).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.scores(x))], names=[*names, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {to} double")


def _residuals(df: DataFrame, vec: str, dims: int, components: int) -> Column:
    """Mean squared error of each row's vector after projection on the
    principal components (fitted here, one pass)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = df.select(array_to_vector(vec).alias("v"))
    axes = PCA(k=components, inputCol="v", outputCol="p").fit(v).pc.toArray()
    mean = df.agg(*[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(dims)]).first()
    centred = [F.col(vec)[i] - F.lit(float(mean[i])) for i in range(dims)]
    keep = np.eye(dims) - axes @ axes.T  # what the components leave
    left = [sum(centred[j] * float(keep[i][j]) for j in range(dims)) for i in range(dims)]
    return sum(e * e for e in left) / dims


def _scaled(c: str, lo: str, hi: str) -> Column:
    return F.when(F.col(hi) - F.col(lo) < 1e-10, 0.0).otherwise((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)))


def _blend(x: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add anomaly_score: the parts, each scaled to 0..1, by weight."""
    one = x.agg(*[f(c).alias(f"_{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    x = x.crossJoin(F.broadcast(one))
    score = sum(_scaled(c, f"_lo_{c}", f"_hi_{c}") * w for c, w in weights.items())
    return x.withColumn("anomaly_score", score).drop(*one.columns)


def _rated(x: DataFrame) -> DataFrame:
    """Add severity by the score's quantiles, and whether it reaches the least."""
    limits = dict(zip(SEVERITIES, exact_quantiles(x, ["anomaly_score"], list(SEVERITIES.values()))["anomaly_score"]))
    s, severity = F.col("anomaly_score"), F.lit("Normal")
    for name in reversed(SEVERITIES):
        severity = F.when(s >= F.lit(limits[name]).cast("double"), name).otherwise(severity)
    return x.withColumn("severity", severity).withColumn("is_anomaly", F.col("severity") != "Normal")


def _prepared(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    scaled = robust_scale(df, keys, cols)
    return materialize_table(scaled.select(*keys, F.array(*[F.coalesce(F.col(f"{c}_scaled"), F.lit(0.0)) for c in cols]).alias("vec")), "anomaly-vectors")


def anomaly_ensemble(df: DataFrame, key: str, keep: list[str], cols: list[str], trees: int = TREES, sample: int = SAMPLE, neighbors: int = NEIGHBORS) -> DataFrame:
    """Forest, local outlier factor (cut at its 1 % and 99 % quantiles) and
    principal-component residual of robust-scaled features, blended .4/.3/.3,
    with severity and percentile (W11: average rank)."""
    x = _prepared(df, [key, *keep], cols)
    forest = grow_forest(x, key, "vec", len(cols), trees, sample)
    wide = x.select("*", *[F.col("vec")[i].alias(f"_f{i}") for i in range(len(cols))])
    lof = materialize_table(outlier_factors(wide, key, [f"_f{i}" for i in range(len(cols))], neighbors), "anomaly-lof")
    low, high = exact_quantiles(lof, ["lof"], [0.01, 0.99])["lof"]
    cut = F.greatest(F.least(F.coalesce("lof", F.lit(1.0)), F.lit(high).cast("double")), F.lit(low).cast("double")).alias("lof")
    components = max(2, min(int(len(cols) * 0.8), len(cols) - 1))
    x = forest_scores(x, "vec", forest, "forest").withColumn("residual", _residuals(x, "vec", len(cols), components))
    x = x.withColumn("id", F.col(key).cast("string")).join(lof, "id", "left").select(key, *keep, "forest", cut, "residual")
    x = _blend(materialize_table(x, "anomaly-parts"), WEIGHTS)
    x = _rated(materialize_table(x, "anomaly-scores"))
    return histogram_rank(x, "anomaly_score", prefix="_r").withColumn("percentile", F.col("_r_pct") * 100).drop("_r_rank_min", "_r_rank_avg", "_r_pct")


def anomaly_lite(df: DataFrame, key: str, keep: list[str], cols: list[str], components: int = 3, trees: int = 100, sample: int = SAMPLE) -> DataFrame:
    """Forest, residual and greatest |z-score|, blended .5/.3/.2."""
    x = _prepared(df, [key, *keep], cols)
    forest = grow_forest(x, key, "vec", len(cols), trees, sample, 1.0)
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = [F.abs((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(stats[f"m_{i}"] or 0))) / F.lit(float(stats[f"s_{i}"] or 1) or 1.0)) for i, c in enumerate(cols)]
    scored = df.select(F.col(key).alias("_key"), F.greatest(*z).alias("zscore"))
    x = forest_scores(x, "vec", forest, "forest").withColumn("residual", _residuals(x, "vec", len(cols), min(components, len(cols) - 1)))
    x = x.join(scored, F.col(key) == F.col("_key")).select(key, *keep, "forest", "residual", "zscore")
    return _rated(materialize_table(_blend(materialize_table(x, "anomaly-parts"), LITE_WEIGHTS), "anomaly-scores"))


def site_anomalies(scores: DataFrame) -> DataFrame:
    """Patients, scores, anomaly rate and severity of each site, with
    the number of patients of every severity (pivot, 0 where none)."""
    site = ["study_id", "site_id"]
    rolled = scores.groupBy(*site).agg(
        F.count("*").alias("patient_count"), F.avg("anomaly_score").alias("avg_score"), F.max("anomaly_score").alias("max_score"),
        F.coalesce(F.stddev_samp("anomaly_score"), F.lit(0.0)).alias("std_score"), F.count_if("is_anomaly").alias("anomaly_count"), F.avg("percentile").alias("avg_percentile"))
    rate = F.col("anomaly_count") / F.col("patient_count")
    severity = (F.when((rate > 0.2) | (F.col("max_score") > 0.9), "Critical").when((rate > 0.1) | (F.col("max_score") > 0.7), "High")
                .when(rate > 0.05, "Medium").otherwise("Normal"))
    kinds = [*SEVERITIES, "Normal"]
    counts = scores.groupBy(*site).pivot("severity", kinds).count().fillna(0, kinds).select(*site, *[F.col(k).alias(f"{k.lower()}_count") for k in kinds])
    return rolled.withColumn("anomaly_rate", rate).withColumn("site_severity", severity).join(counts, site, "left")
