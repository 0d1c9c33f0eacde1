"""Agreement of rankings and quality of scores: Kendall's tau, mean average
precision, lift over a baseline, areas under ROC curves (M14, M15, M16, W15).

Orders over all rows are worked out range by range (`running_sums`,
`ordered_row_number`); pairs of rows are counted, never formed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.quantiles import exact_quantiles
from quarry.functions.ranking import running_sums
from quarry.operators.ml import ordered_row_number
from quarry.session import materialize_table

#: Points of one block, in the order of the first score, that one window sorts.
BLOCK_POINTS = 4096


def _points(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) with how often they occur; missing values do not count."""
    x = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return x.where(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.isnan("a") & ~F.isnan("b")).groupBy("a", "b").agg(F.count("*").alias("c"))


def discordant_pairs(points: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """One row `discordant`: the pairs with a < a' and b > b', over points
    (a, b, c) that count c times.

    Points get their place by (a, b), and b its rank among the distinct b.
    Two ranks first differ in one bit, so each pair is met at one bit level,
    among the points that share the bits above: it is discordant if the point
    with the bit comes first.  A level is a sum over blocks of places: what
    earlier blocks hold with the bit, times those without it, and the same
    inside a block.  A point has one row for each level, log2 of the ranks."""
    ranks = ordered_row_number(points.select("b").distinct(), [], ["b"], "rank")
    placed = ordered_row_number(points, [], ["a", "b"], "place").join(ranks, "b")
    placed = materialize_table(placed.select("place", (F.col("rank") - 1).alias("rank"), "c"), "kendall-points")
    top = placed.agg(F.max("rank")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(0, int(top).bit_length() - 1)))
    bits = placed.select("place", "c", "rank", F.floor(F.col("place") / block_points).alias("block"), F.explode(levels).alias("level"))
    # F.shiftright takes a number, the level is a column
    bits = bits.select("place", "level", "block", F.expr("shiftright(rank, level + 1)").alias("above"), F.expr("shiftright(rank, level) & 1").alias("bit"), "c")
    cell = ["level", "above", "block"]
    inside = Window.partitionBy(*cell).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ones, zeros = F.when(F.col("bit") == 1, F.col("c")).otherwise(0), F.when(F.col("bit") == 0, F.col("c")).otherwise(0)
    seen = bits.select(*cell, ones.alias("ones"), zeros.alias("zeros"), F.coalesce(F.sum(ones).over(inside), F.lit(0)).alias("ahead"))
    wide = lambda c: c.cast("decimal(38,0)")
    cells = seen.groupBy(*cell).agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.sum(wide(F.col("zeros") * F.col("ahead"))).alias("within"))
    past = Window.partitionBy("level", "above").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("within", "zeros", F.coalesce(F.sum("ones").over(past), F.lit(0)).alias("ahead"))
    return cells.agg(F.coalesce(F.sum(F.col("within") + wide(F.col("zeros") * F.col("ahead"))), F.lit(0)).cast("bigint").alias("discordant"))


def kendall_tau(df: DataFrame, a: str, b: str, block_points: int = BLOCK_POINTS) -> DataFrame:
    """One row with Kendall's tau-b of two scores and the pairs it counts:
    all, tied in a, tied in b, tied in both, concordant and discordant.  Null
    where either score is constant."""
    points = materialize_table(_points(df, a, b), "kendall")
    pairs = lambda c: (c * (c - 1) / 2).cast("bigint")
    tied = lambda by, name: points.groupBy(by).agg(F.sum("c").alias("c")).agg(F.coalesce(F.sum(pairs(F.col("c"))), F.lit(0)).alias(name))
    one = points.agg(F.coalesce(pairs(F.sum("c")), F.lit(0)).alias("pairs"), F.coalesce(F.sum(pairs(F.col("c"))), F.lit(0)).alias("tied_both"))
    one = one.crossJoin(tied("a", "tied_a")).crossJoin(tied("b", "tied_b")).crossJoin(discordant_pairs(points, block_points))
    one = one.withColumn("concordant", F.expr("pairs - tied_a - tied_b + tied_both - discordant"))
    root = F.sqrt(F.expr("CAST(pairs - tied_a AS DOUBLE)")) * F.sqrt(F.expr("CAST(pairs - tied_b AS DOUBLE)"))
    return one.select("pairs", "tied_a", "tied_b", "tied_both", "concordant", "discordant",
                      F.when(root > 0, F.expr("concordant - discordant") / root).alias("kendall_tau"))


def mean_average_precision(df: DataFrame, item: str, pred: str, truth: str, share: float = 0.75) -> DataFrame:
    """Rows whose truth reaches its `share` quantile are relevant;
    the mean precision at each of them in the ranking by `pred` (ties by item)."""
    x = df.select(item, pred, truth).dropna()
    cut = exact_quantiles(x, [truth], [share])[truth][0]
    x = x.select(item, (-F.col(pred)).alias("_down"), F.lit(1).alias("row"), (F.col(truth) >= F.lit(cut)).cast("long").alias("hit"))
    x = running_sums(x, ["_down", item], ["row", "hit"])
    precision = (F.col("hit_before") + 1) / (F.col("row_before") + 1)
    return x.where("hit = 1").agg(F.count("*").alias("relevant"), F.coalesce(F.avg(precision), F.lit(0.0)).alias("map"))


def rank_agreement(df: DataFrame, item: str, pred: str, truth: str, baseline: str) -> DataFrame:
    """Mean average precision, Kendall's tau of a ranking and of a
    baseline with the truth, and the lift of one over the other."""
    tau = kendall_tau(df, truth, pred).select("kendall_tau")
    base = kendall_tau(df, truth, baseline).select(F.col("kendall_tau").alias("baseline_tau"))
    return (mean_average_precision(df, item, pred, truth).crossJoin(tau).crossJoin(base)
            .withColumn("lift_over_baseline", F.col("kendall_tau") - F.col("baseline_tau")))


def roc_auc(df: DataFrame, score: str, classes: dict[str, Column]) -> DataFrame:
    """Area under the ROC curve of a score for each class against the
    rest, ties counting half, and the mean weighted by class size.  Null where
    a class or the rest is empty."""
    x = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    names = list(classes)
    h = x.groupBy(F.col(score).alias("t")).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(classes[k], F.lit(False)).cast("long")).alias(f"p{i}") for i, k in enumerate(names)])
    h = running_sums(h, ["t"], ["n", *[f"p{i}" for i in range(len(names))]])
    below = lambda i: F.col("n_before") - F.col(f"p{i}_before") + (F.col("n") - F.col(f"p{i}")) / 2
    one = h.agg(F.sum("n").alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(names))],
                *[F.sum(F.col(f"p{i}") * below(i)).alias(f"s{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(k).alias("class"), F.coalesce(F.col(f"p{i}"), F.lit(0)).alias("positives"), F.col("n"), F.col(f"s{i}").alias("s")) for i, k in enumerate(names)])
    rest = F.col("n") - F.col("positives")
    out = one.select(F.explode(rows).alias("r")).select("r.*").select("class", "positives", F.when((F.col("positives") > 0) & (rest > 0), F.col("s") / (F.col("positives") * rest)).alias("roc_auc"))
    known = out.where("roc_auc IS NOT NULL")
    mean = known.agg(F.lit("weighted").alias("class"), F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
                     (F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")).alias("roc_auc"))
    return out.unionByName(mean)
