"""Neighbours, outlier factors, synthetic rows, forests and site rollups against plain versions."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import anomaly as AN
from quarry.operators import neighbors as NB


def plain_nearest(rows, k):
    ids = [r[0] for r in rows]
    d = NB.distances(np.array([r[1:] for r in rows], float), np.array([r[1:] for r in rows], float))
    return {i: sorted((d[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k] for a, i in enumerate(ids)}


def table(kind, n=700):
    rng = random.Random(kind)
    rows = []
    for i in range(n):
        if kind == "lattice":  # ties everywhere
            v = [rng.randrange(6), rng.randrange(6), rng.randrange(3)]
        elif kind == "copies":  # half of all rows are one vector
            v = [1, 2, 3] if rng.random() < 0.5 else [rng.gauss(0, 2) for _ in range(3)]
        else:  # clusters and far outliers
            c = rng.choice([0, 0, 0, 50])
            v = [c + rng.gauss(0, 1) for _ in range(3)] if rng.random() < 0.97 else [rng.uniform(-500, 500) for _ in range(3)]
        rows.append((f"r{i:04d}", *map(float, v)))
    return rows


@pytest.mark.parametrize("kind,k", [("lattice", 3), ("copies", 5), ("clusters", 20), ("clusters", 1)])
def test_nearest_rows_equal_brute_force(spark, monkeypatch, kind, k):
    monkeypatch.setattr(NB, "VISITS", 40)
    rows = table(kind)
    df = spark.createDataFrame(rows, "id string, a double, b double, c double").repartition(5)
    got = {r["id"]: [(n["d"], n["id"]) for n in r["near"]] for r in NB.nearest_rows(df, "id", ["a", "b", "c"], k).collect()}
    assert got == plain_nearest(rows, k)


def test_nearest_rows_of_few_and_missing_rows(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", None), (None, 2.0), ("z", float("nan")), ("w", 4.0)], "id string, a double")
    assert {r["id"]: [n["id"] for n in r["near"]] for r in NB.nearest_rows(df, "id", ["a"], 3).collect()} == {"x": ["w"], "w": ["x"]}
    assert NB.nearest_rows(df.limit(0), "id", ["a"], 3).collect() == []


def test_outlier_factors_equal_plain_ones(spark):
    rows, k = table("clusters", 300), 10
    near = plain_nearest(rows, k)
    kdist = {i: n[-1][0] for i, n in near.items()}
    lrd = {i: 1 / (np.mean([max(kdist[o], d) for d, o in n]) + 1e-10) for i, n in near.items()}
    want = {i: np.mean([lrd[o] for _, o in n]) / lrd[i] for i, n in near.items()}
    df = spark.createDataFrame(rows, "id string, a double, b double, c double")
    got = {r["id"]: r["lof"] for r in NB.outlier_factors(df, "id", ["a", "b", "c"], k).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 * want[i] for i in want)


def test_synthetic_rows_lie_between_neighbours_and_balance_classes(spark):
    rows = [(i, "a" if n < 400 else "b" if n < 480 else "c", *v) for n, (i, *v) in enumerate(table("clusters", 481))]
    df = spark.createDataFrame(rows, "id string, y string, a double, b double, c double").repartition(4)
    got = NB.smote(df, "id", "y", ["a", "b", "c"], 3).collect()
    assert Counter(r["label"] for r in got) == {"a": 400, "b": 400, "c": 400} and len({r["id"] for r in got}) == 1200
    values = {r[0]: np.array(r[2:]) for r in rows}
    near = plain_nearest([(i, *v) for i, y, *v in rows if y == "b"], 3)
    bases = Counter()
    for r in got:
        v = np.array([r["a"], r["b"], r["c"]])
        if not r["synthetic"]:
            assert (v == values[r["id"]]).all()
        elif r["label"] == "c":
            assert r["other"] is None and (v == values["r0480"]).all()
        else:
            assert r["other"] in [o for _, o in near[r["base"]]] and 0 <= r["gap"] < 1
            assert np.allclose(v, values[r["base"]] + r["gap"] * (values[r["other"]] - values[r["base"]]))
            bases[r["base"]] += 1
    assert len(bases) > 60 and max(bases.values()) < 20
    again = NB.smote(df.repartition(2), "id", "y", ["a", "b", "c"], 3)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_forest_scores_equal_a_plain_walk(spark):
    rows = table("clusters", 600)
    df = spark.createDataFrame([(i, list(v)) for i, *v in rows], "id string, vec array<double>").repartition(3)
    forest = AN.grow_forest(df, "id", "vec", 3, 20, 64)
    values = {i: v for i, *v in rows}
    assert forest.size[:, 1].tolist() == [64] * 20  # every tree sees its sample
    for t in range(20):
        for node in range(1, forest.feature.shape[1] // 2):
            if forest.feature[t, node] >= 0:  # both sides of a split hold rows
                assert forest.size[t, 2 * node] + forest.size[t, 2 * node + 1] == forest.size[t, node] and forest.size[t, 2 * node] * forest.size[t, 2 * node + 1] > 0
    got = {r["id"]: r["forest_score"] for r in AN.forest_scores(df, "vec", forest).collect()}
    for i, v in values.items():
        paths = []
        for t in range(20):
            node = depth = 1
            depth = 0
            while forest.feature[t, node] >= 0:
                node, depth = 2 * node + (v[forest.feature[t, node]] >= forest.threshold[t, node]), depth + 1
            paths.append(depth + float(AN.average_path(forest.size[t, node])))
        assert abs(got[i] - 2 ** (-np.mean(paths) / float(AN.average_path(64)))) < 1e-12
    far = [i for i, v in values.items() if max(map(abs, v)) > 150]
    assert np.mean([got[i] for i in far]) > np.mean(list(got.values())) + 0.1
    again = AN.grow_forest(df.repartition(7), "id", "vec", 3, 20, 64)
    assert (again.feature == forest.feature).all() and (again.threshold == forest.threshold).all()


def test_average_path():
    assert AN.average_path(1) == 0 and AN.average_path(2) == 1 and abs(float(AN.average_path(256)) - 10.244770920) < 1e-6


def test_ensemble_finds_outliers_and_rates_them(spark):
    rows = table("clusters", 500)
    df = spark.createDataFrame([(i, "s1", f"t{n % 7}", *v) for n, (i, *v) in enumerate(rows)], "id string, study_id string, site_id string, a double, b double, c double")
    got = AN.anomaly_ensemble(df, "id", ["study_id", "site_id"], ["a", "b", "c"], 50, 128, 10).collect()
    s = np.array([r["anomaly_score"] for r in got])
    for r in got:
        want = "Critical" if r["anomaly_score"] >= np.quantile(s, 0.99) else "High" if r["anomaly_score"] >= np.quantile(s, 0.95) else "Medium" if r["anomaly_score"] >= np.quantile(s, 0.9) else "Normal"
        assert r["severity"] == want and r["is_anomaly"] == (want != "Normal")
        assert abs(r["percentile"] - ((s < r["anomaly_score"]).sum() + ((s == r["anomaly_score"]).sum() + 1) / 2) / len(s) * 100) < 1e-9
    parts = {c: np.array([r[c] for r in got]) for c in AN.WEIGHTS}
    blend = sum(w * (parts[c] - parts[c].min()) / (parts[c].max() - parts[c].min()) for c, w in AN.WEIGHTS.items())
    assert np.allclose(blend, s)
    x = np.array([[v for v in r[1:]] for r in rows])  # residual: plain projection
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    z = (x - q[1]) / (q[2] - q[0])
    c = z - z.mean(axis=0)
    axes = np.linalg.eigh(np.cov(c.T))[1][:, ::-1][:, :2]
    want = dict(zip([r[0] for r in rows], ((c - c @ axes @ axes.T) ** 2).mean(axis=1)))
    assert all(abs(r["residual"] - want[r["id"]]) < 1e-6 * max(1, want[r["id"]]) for r in got)
    far = {i for i, *v in rows if max(map(abs, v)) > 150}
    assert len(far & {r["id"] for r in got if r["is_anomaly"]}) > 0.8 * len(far)


def test_site_rollup(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 2}", f"t{rng.randrange(4)}", rng.random(), rng.choice(["Normal"] * 8 + ["High", "Critical"]), rng.random() * 100) for i in range(200)] + [("s9", "t9", 0.2, "Normal", 1.0)]
    df = spark.createDataFrame([(*r, r[3] != "Normal") for r in rows], "study_id string, site_id string, anomaly_score double, severity string, percentile double, is_anomaly boolean")
    by = defaultdict(list)
    for r in rows:
        by[r[:2]].append(r)
    got = {(r["study_id"], r["site_id"]): r for r in AN.site_anomalies(df).collect()}
    assert got.keys() == by.keys()
    for k, own in by.items():
        s, n = [r[2] for r in own], Counter(r[3] for r in own)
        rate, r = 1 - n["Normal"] / len(own), got[k]
        severity = "Critical" if rate > 0.2 or max(s) > 0.9 else "High" if rate > 0.1 or max(s) > 0.7 else "Medium" if rate > 0.05 else "Normal"
        assert (r["patient_count"], r["anomaly_count"], r["critical_count"], r["high_count"], r["medium_count"], r["normal_count"], r["site_severity"]) == (
            len(own), len(own) - n["Normal"], n["Critical"], n["High"], 0, n["Normal"], severity)
        assert abs(r["avg_score"] - np.mean(s)) < 1e-9 and abs(r["std_score"] - (np.std(s, ddof=1) if len(s) > 1 else 0)) < 1e-9
