"""Histogram boosting against plain trees, and what the models are worth on rows they have not seen."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import boosting as BO
from quarry.operators import models as MO
from quarry.operators import reports as RP


def table(seed=1, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.choice([0, 1, 2, 3]), rng.random()
        kind = "x" if a > 0.7 else "y" if b >= 2 and c > 0.4 else "z"
        kind = kind if rng.random() < 0.9 else rng.choice("xyz")
        days = 3 + 20 * (b == 3) + 40 * (a > 1) + rng.expovariate(1 / (2 + 4 * b))
        rows.append((i, a if rng.random() < 0.95 else None, b, c, kind, days))
    return rows


DDL = "id int, a double, b int, c double, kind string, days double"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(table(), DDL).repartition(4)


def plain_tree(bins, y, p, outputs, k, depth, rate):
    """One tree by trying every feature and cut on the rows themselves."""
    g, h = BO.gradients(outputs, y, p)
    tree = BO.Tree.empty(depth)

    def grow(node, rows, level):
        G, H = g[rows, k].sum(), h[rows, k].sum()
        tree.value[node] = -rate * G / (H + BO.DECAY)
        best = (1e-9, None)
        if level < depth:
            for f in range(bins.shape[1]):
                for cut in range(BO.BINS + 1):
                    left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                    if min(len(left), len(right)) >= BO.LEAST_ROWS:
                        gain = sum(g[s, k].sum() ** 2 / (h[s, k].sum() + BO.DECAY) for s in (left, right)) - G ** 2 / (H + BO.DECAY)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut, left, right))
        if best[1]:
            f, cut, left, right = best[1]
            tree.feature[node], tree.cut[node] = f, cut
            grow(2 * node, left, level + 1)
            grow(2 * node + 1, right, level + 1)

    grow(1, np.flatnonzero(~np.isnan(y[:, k])), 0)
    return tree


def test_first_trees_equal_plain_ones(df):
    outputs = [BO.Output(c, F.when(F.col("id") % 5 != 0, (F.col("kind") == c).cast("double")), "softmax", group="g") for c in "xyz"] + [BO.Output("q", F.when(F.col("id") % 3 == 0, F.col("days")), "logistic")]
    outputs[3] = BO.Output("big", F.when(F.col("id") % 3 == 0, (F.col("days") > 10).cast("double")), "logistic")
    start = BO.prepare(df, "id", ["a", "b", "c"], outputs).rows.collect()
    bins, y, p = (np.array([r[c] for r in start], float) for c in ("bins", "y", "p"))
    model = BO.boost(df, "id", ["a", "b", "c"], outputs, rounds=1)
    for k in range(4):
        want, got = plain_tree(bins.astype(int), y, p, outputs, k, BO.DEPTH, BO.RATE), model.trees[0][k]
        assert (want.feature == got.feature).all() and np.allclose(want.value, got.value)
        assert (want.cut == got.cut)[want.feature >= 0].all()


def test_rows_are_kept_as_single_values(df):
    """A pass reads a binary value for each of bins, y and p; arrays cost a step per element."""
    outputs = [BO.Output("d", F.when(F.col("id") % 2 == 0, F.col("days")), "quantile", 0.5), BO.Output("big", (F.col("days") > 10).cast("double"), "logistic")]
    model = BO.prepare(df, "id", ["a", "b", "c"], outputs)
    assert dict(model.packed.dtypes) == {"id": "string", "bins": "binary", "y": "binary", "p": "binary"}
    days = {str(r["id"]): r["days"] for r in df.collect()}
    for r in model.rows.collect():
        assert r["y"][1] == (days[r["id"]] > 10) and (r["y"][0] == days[r["id"]] if int(r["id"]) % 2 == 0 else np.isnan(r["y"][0]))
    for r, p in zip(model.packed.limit(50).collect(), model.rows.limit(50).collect()):
        assert list(np.frombuffer(r["bins"], model.kind)) == p["bins"] and list(np.frombuffer(r["p"])) == p["p"]


def test_written_rounds_change_nothing(df, monkeypatch):
    outputs = [BO.Output("d", F.col("days"), "quantile", 0.5), BO.Output("big", (F.col("days") > 10).cast("double"), "logistic")]
    one = {r["id"]: r["p"] for r in BO.predicted(BO.boost(df, "id", ["a", "b", "c"], outputs, rounds=5)).collect()}
    monkeypatch.setattr(BO, "WRITTEN_EVERY", 2)
    two = {r["id"]: r["p"] for r in BO.predicted(BO.boost(df.repartition(2), "id", ["a", "b", "c"], outputs, rounds=5)).collect()}
    assert one.keys() == two.keys() and all(np.allclose(one[i], two[i]) for i in one)


def test_classes_of_unseen_rows(df):
    got = MO.risk_classifier(df, "id", ["a", "b", "c"], "kind", ["x", "y", "z"], ["days"]).collect()
    test = [r for r in got if r["split"] == "test"]
    assert 200 < len(test) < 400 and len(got) == 1500
    assert all(abs(r["p_x"] + r["p_y"] + r["p_z"] - 1) < 1e-9 for r in got)

    def macro_f1(pairs):
        out = []
        for c in "xyz":
            tp, pred, true = sum(a == b == c for a, b in pairs), sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
            out.append(2 * tp / (pred + true) if pred + true else 0)
        return np.mean(out)

    score = macro_f1([(r["label"], r["predicted"]) for r in test])
    largest = max("xyz", key=lambda c: sum(r["label"] == c for r in got))
    assert score > 0.8 > macro_f1([(r["label"], largest) for r in test]) + 0.3
    with pytest.raises(ValueError):
        MO.risk_classifier(df, "id", ["a", "days"], "kind", ["x", "y", "z"], ["days"])


def test_labels_of_unseen_rows(df):
    x = df.withColumn("l1", (F.col("kind") == "x").cast("int")).withColumn("l2", (F.rand(3) < 0.3).cast("int")).withColumn("l3", F.lit(0)).withColumn("l4", F.lit(1))
    got = {r["label"]: r for r in MO.issue_classifiers(x, "id", ["a", "b", "c"], ["l1", "l2", "l3", "l4"], F.col("id") % 4 == 0).collect()}
    assert got["l1"]["auc"] > 0.85 and abs(got["l2"]["auc"] - 0.5) < 0.12  # noise stays noise on unseen rows
    assert not got["l3"]["trained"] and not got["l4"]["trained"] and got["l3"]["auc"] is None


def test_quantiles_of_unseen_rows(df):
    held = F.col("id") % 5 == 0
    got = MO.resolution_quantiles(df, "id", ["a", "b", "c"], "days", held)
    test = got.where("held_out")
    cells = RP.quantile_baseline(df.where(~held), ["kind"], "days")
    base = df.where(held).join(cells.drop("n"), "kind")
    quantiles = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    ours, theirs = (MO.pinball(x, "days", quantiles).first() for x in (test, base))
    assert sum(ours) < 0.9 * sum(theirs)
    rows = test.collect()
    cover = np.mean([r["p10"] <= r["days"] <= r["p90"] for r in rows])
    assert 0.7 < cover <= 0.97 and all(0 <= r["p10"] <= r["p90"] and r["p90"] - r["p10"] >= 7.9 * 0.7 for r in rows)
    assert {r["confidence"] for r in rows} >= {"HIGH", "LOW"}


def test_best_split_of_nothing():
    assert BO.best_split(np.zeros((3, 5, 3)))[0] == -1
