"""Ranking agreement, curves and quantiles against plain counts."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.quantiles import exact_quantiles, group_quantiles
from quarry.functions.ranking import histogram_rank, running_sums
from quarry.operators import evaluation as EV
from quarry.operators import ml as ML


def plain_tau(rows):
    a, b = np.array(rows, float).T
    da, db = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    upper = np.triu(np.ones((len(a), len(a)), bool), 1)
    s = (da * db)[upper]
    n, ta, tb = int(upper.sum()), int((da[upper] == 0).sum()), int((db[upper] == 0).sum())
    return n, ta, tb, int(((da == 0) & (db == 0))[upper].sum()), int((s > 0).sum()), int((s < 0).sum()), s.sum() / math.sqrt(n - ta) / math.sqrt(n - tb)


@pytest.mark.parametrize("n,values,block", [(5000, 10_000, 64), (5000, 40, 7), (2000, 3, 4096), (2, 9, 1)])
def test_kendall_tau_counts_every_pair(spark, n, values, block):
    rng = random.Random(n + values)
    rows = [(rng.randrange(values) / 7, rng.randrange(values) / 3) for _ in range(n)]
    rows = [(a, a - 2 if rng.random() < 0.4 else b) for a, b in rows]
    if n == 2:
        rows = [(1.0, 2.0), (3.0, -4.0)]
    df = spark.createDataFrame(rows + [(None, 1.0), (1.0, None), (float("nan"), 1.0)], "x double, y double").repartition(5)
    got = EV.kendall_tau(df, "x", "y", block).first()
    want = plain_tau(rows)
    assert tuple(got)[:6] == want[:6] and abs(got["kendall_tau"] - want[6]) < 1e-9


def test_kendall_of_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "x double, y double")
    assert EV.kendall_tau(df, "x", "y").first()["kendall_tau"] is None
    assert tuple(EV.kendall_tau(df.limit(0), "x", "y").first()) == (0, 0, 0, 0, 0, 0, None)


def test_most_points_on_one_value(spark):
    """Half of the rows share one score: they are one point or one tie group."""
    rng = random.Random(4)
    rows = [(5.0, rng.randrange(50) * 1.0) for _ in range(1500)] + [(rng.random() * 10, rng.randrange(50) * 1.0) for _ in range(1500)]
    got = EV.kendall_tau(spark.createDataFrame(rows, "x double, y double"), "x", "y", 32).first()
    assert tuple(got)[:6] == plain_tau(rows)[:6]


def test_map_and_lift(spark):
    rng = random.Random(8)
    rows = [(f"i{i:03d}", rng.randrange(30) * 1.0, rng.randrange(30) * 1.0, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "item string, pred double, truth double, base double").repartition(4)
    got = EV.rank_agreement(df, "item", "pred", "truth", "base").first()
    cut = np.quantile([r[2] for r in rows], 0.75)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    hits, precisions = 0, []
    for place, r in enumerate(order, 1):
        if r[2] >= cut:
            hits += 1
            precisions.append(hits / place)
    tau, base = plain_tau([(r[2], r[1]) for r in rows])[6], plain_tau([(r[2], r[3]) for r in rows])[6]
    assert got["relevant"] == hits and abs(got["map"] - np.mean(precisions)) < 1e-9
    assert abs(got["kendall_tau"] - tau) < 1e-9 and abs(got["lift_over_baseline"] - (tau - base)) < 1e-9


def test_roc_auc_is_the_share_of_ordered_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(25) / 4, rng.choice(["a", "a", "b", None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y string").repartition(3)
    got = {r["class"]: r for r in EV.roc_auc(df, "s", {k: F.col("y") == k for k in "abz"}).collect()}
    for k in "ab":
        pos, neg = [s for s, y in rows if y == k], [s for s, y in rows if y != k]
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        assert got[k]["positives"] == len(pos) and abs(got[k]["roc_auc"] - want) < 1e-9
    assert got["z"]["roc_auc"] is None
    assert abs(got["weighted"]["roc_auc"] - sum(got[k]["roc_auc"] * got[k]["positives"] for k in "ab") / sum(got[k]["positives"] for k in "ab")) < 1e-9


def test_threshold_with_a_least_recall(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(40) / 40, rng.random() < 0.3) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, y boolean").repartition(3)
    for least in (0.0, 0.5, 0.9, 1.0):
        best = None
        for t in sorted({s for s, _ in rows}):
            tp, pp = sum(y for s, y in rows if s >= t), sum(s >= t for s, _ in rows)
            p, r = tp / pp, tp / sum(y for _, y in rows)
            f = 2 * p * r / (p + r) if p + r else 0.0
            if r >= least and (best is None or f > best[1] + 1e-12):
                best = (t, f, r)
        got = ML.best_f1_threshold(df, "s", F.col("y"), least).first()
        assert (got["threshold"], round(got["f1"], 9), round(got["recall"], 9)) == (best[0], round(best[1], 9), round(best[2], 9))


def test_running_sums_and_ranks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(100), rng.randrange(9)) for i in range(1000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, v int, w int").repartition(6)
    got = {r["i"]: r["w_before"] for r in running_sums(df, ["i"], ["w"]).collect()}
    by = sorted(rows)
    assert got == {r[0]: sum(x[2] for x in by[:k]) for k, r in enumerate(by)}
    ranks = {r["i"]: (r["v_rank_min"], r["v_rank_avg"], r["v_pct"]) for r in histogram_rank(df, "v", ascending=False).collect()}
    for i, v, _ in rows:
        above, same = sum(x[1] > v for x in rows), sum(x[1] == v for x in rows)
        assert ranks[i] == (above + 1, above + (same + 1) / 2, (above + (same + 1) / 2) / 1000)


def test_quantiles_with_infinite_and_missing_values(spark):
    inf, nan = float("inf"), float("nan")
    for values in ([1.0, 2.0, inf], [-inf, 1.0, 2.0, 5.0, inf, inf], [nan, 3.0, None, 4.0], [-1.7e308, 0.0, 1.7e308], [5e-324, 1e-323, 0.0], [inf], [nan], [-inf, inf]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = exact_quantiles(df, ["x"], [0.0, 0.5, 1.0])["x"]
        known = sorted(v for v in values if v is not None and v == v)
        if not known:
            assert got == [None] * 3
            continue
        mid = (len(known) - 1) / 2
        lo, hi = known[math.floor(mid)], known[math.ceil(mid)]
        assert got[0] == known[0] and got[2] == known[-1] and (got[1] == (lo if lo == hi else lo / 2 + hi / 2) or (lo == -inf and hi == inf and math.isnan(got[1])))


def test_group_quantiles(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1.5, 2.0, rng.random() * 9, None, float("nan")])) for _ in range(900)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in group_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect()}
    by = {}
    for g, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert got.keys() == by.keys() and all(np.allclose(got[g], np.quantile(by[g], [0.1, 0.5, 0.9])) for g in by)
    every = group_quantiles(df, [], "v", [0.25]).first()["q0"]
    assert abs(every - np.quantile([v for own in by.values() for v in own], 0.25)) < 1e-9
