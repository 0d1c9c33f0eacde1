"""Set joins, transfers and dictionary search against full comparison."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators import matching as MA


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("least", [0.2, 1 / 3, 0.5, 0.8, 1.0])
def test_similar_sets_equal_full_comparison(spark, least):
    rng = random.Random(int(least * 100))
    tokens = [f"t{i}" for i in range(25)]
    weights = [1 / (i + 1) for i in range(25)]  # a few tokens are in most sets
    rows = [(f"s{i:03d}", rng.choice("pq"), sorted(set(rng.choices(tokens, weights, k=rng.randrange(0, 9))))) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, part string, tokens array<string>").repartition(4)
    got = {(r["a"], r["b"]): r["jaccard"] for r in MA.similar_sets(df, least).collect()}
    want = {(a, b): plain_jaccard(set(x), set(y)) for a, p, x in rows for b, q, y in rows if a < b and p == q and plain_jaccard(set(x), set(y)) >= least - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_least_similarity_is_needed(spark):
    with pytest.raises(ValueError):
        MA.similar_sets(spark.createDataFrame([("a", "p", ["x"])], "id string, part string, tokens array<string>"), 0.0)


@pytest.mark.parametrize("skewed", [False, True])
def test_best_transfers_equal_full_comparison(spark, skewed):
    rng = random.Random(5)
    kinds = ["sdv", "sae", "query"]
    rows = []
    for i in range(400):
        hot = skewed and rng.random() < 0.6  # most items are one class, most of them in one study
        study = "A" if hot and rng.random() < 0.9 else rng.choice("ABCD")
        tokens = ["x", "y"] if hot else sorted(set(rng.choices("uvwxyz", k=rng.randrange(0, 5))))
        rows.append((f"i{i:03d}", study, "sdv" if hot else rng.choice(kinds), "High" if hot else rng.choice(list(MA.SEVERITY_SCORES)), tokens, round(rng.uniform(0.5, 1), 2)))
    df = spark.createDataFrame(rows, "item string, study string, type string, severity string, tokens array<string>, confidence double").repartition(5)
    got = defaultdict(list)
    matches = MA.transfer_matches(df)
    for r in sorted(matches.collect(), key=lambda r: (r["target_study"], r["place"])):
        got[r["target_study"]].append((r["source"], r["target"], round(r["confidence"], 9), r["affected"]))
    for study in "ABCD":
        found = []
        for a, s, k, v, x, c in rows:
            for b, t, l, w, y, d in rows:
                if s != study == t and k == l:
                    sim = 0.4 + 0.3 * plain_jaccard(set(x), set(y)) + (0.2 if v == w else 0)
                    if sim >= 0.7:
                        found.append((-min(c, d) * sim, -c, -d, a, b, sum(r[2:5] == (k, v, x) for r in rows)))
        assert got[study] == [(a, b, round(-c, 9), n) for c, _, _, a, b, n in sorted(found)[:5]]
    for r in MA.transfer_recommendations(matches).collect():
        score = r["confidence"] * 0.4 + MA.SEVERITY_SCORES[r["source_severity"]] * 0.3 + (0.3 if r["affected"] >= 100 else 0.2 if r["affected"] >= 50 else 0.1 if r["affected"] >= 20 else 0)
        assert r["confidence"] >= 0.6 and r["priority"] == ("Critical" if score >= 0.8 else "High" if score >= 0.6 else "Medium" if score >= 0.4 else "Low")
        order = list(MA.SEVERITY_SCORES)
        assert r["severity_calibration"] == (abs(order.index(r["source_severity"]) - order.index(r["target_severity"])) > 1)


def test_sets_of_one_file_are_compared_by_many_tasks(spark):
    rng = random.Random(3)
    sets = {tuple(sorted({"in all", *rng.sample("abcdefghij", rng.randrange(1, 8))})) for _ in range(400)}
    df = spark.createDataFrame([(",".join(t), None, list(t)) for t in sets], "id string, part string, tokens array<string>").coalesce(1)
    got = MA.similar_sets(df, 0.3).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r["a"], r["b"]) for r in got}) == len(got) == sum(plain_jaccard(set(x), set(y)) >= 0.3 - 1e-9 for x in sets for y in sets if x < y)
    assert len({r["task"] for r in got}) > 8


def test_classes_that_cannot_reach_the_best_are_not_compared(spark, monkeypatch):
    rng = random.Random(8)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randrange(1, 7))) for _ in range(200)]
    rows = [(f"i{i:03d}", "ABC"[i % 3], "sdv", "High", x, 0.7) for i, x in enumerate(sets)]
    rows += [(f"t{i}", "ABC"[i % 3], "sdv", "High", ["x", "y"], 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "item string, study string, type string, severity string, tokens array<string>, confidence double")
    compared, plain = [], MA.similar_sets
    monkeypatch.setattr(MA, "similar_sets", lambda sets, least: (compared.append(sets.count()), plain(sets, least))[1])
    got = MA.transfer_matches(df).collect()
    assert len(got) == 15 and all(r["confidence"] == pytest.approx(0.9) and r["source"][0] == r["target"][0] == "t" for r in got)
    assert max(compared) <= 1


def plain_search(queries, dictionary, variations, best):
    out = {}
    for query in {q for q in queries if q.strip()}:
        q, found = query.lower().strip(), {}
        for code, term in dictionary:
            t = term.lower()
            options = [(0, 1.0)] if any(v.lower() == q and s == term for v, s in variations) else []
            if q == t:
                options.append((1, 1.0))
            elif t and q in t:
                options.append((2, len(q) / len(t)))
            elif t and t in q:
                options.append((3, len(t) / len(q)))
            if q in code.lower():
                options.append((4, 0.9))
            if options:
                found[code, term] = min(options)
        ranked = sorted((-s, k, c, t) for (c, t), (k, s) in found.items())[:best]
        out[query] = [(c, t, ("exact_variation", "exact", "contains", "partial", "code")[k], round(-s, 9)) for s, k, c, t in ranked]
    return {k: v for k, v in out.items() if v}


def test_dictionary_search_equals_full_comparison(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("aabé") for _ in range(n))
    dictionary = [(f"10{i:03d}", word(rng.randrange(1, 9)).title()) for i in range(150)] + [("20001", "Head ache"), ("20002", "Ache"), ("20003", "")]
    variations = [("Cephalalgia", "Head ache"), ("aa", dictionary[0][1]), ("nothing", "no such term")]
    queries = ["Cephalalgia", " head ACHE ", "head ache today", "ache", "1000", "20001", "a", "é", "", "  ", "zzz", "nothing", "aa"] + [word(rng.randrange(1, 30)) for _ in range(60)]
    frames = (spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(dictionary, "code string, term string"), spark.createDataFrame(variations, "variation string, term string"))
    for best in (3, 200):
        got = defaultdict(list)
        for r in sorted(MA.search_dictionary(*frames, best).collect(), key=lambda r: r["place"]):
            got[r["query"]].append((r["code"], r["term"], r["match_type"], round(r["score"], 9)))
        assert got == plain_search(queries, dictionary, variations, best)
    assert MA.search_dictionary(frames[0].limit(0), frames[1], frames[2]).collect() == []


def test_needles_are_paired_with_what_holds_them_alone(spark):
    rng = random.Random(5)
    text = lambda least, most: "".join(rng.choice("abé") for _ in range(rng.randrange(least, most)))
    needles = [text(0, 9) for _ in range(120)] + [text(17, 22) for _ in range(20)]
    hay = [text(0, 12) for _ in range(150)] + [text(1, 9) + n + text(1, 9) for n in needles[-10:]] + [None]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    pairs = lambda some: sorted((i, j) for i, n in some for j, h in enumerate(hay) if n and h and n in h)
    got = MA._holding(frame(needles), frame(hay))
    assert sorted(map(tuple, got.collect())) == pairs(enumerate(needles))
    short = MA._holding(frame(needles[:120]), frame(hay))
    assert sorted(map(tuple, short.collect())) == pairs(enumerate(needles[:120]))
    assert "Contains" not in short._jdf.queryExecution().toString()


def test_dictionary_query_reads_the_documents_once(spark):
    from quarry.plans import REGISTRY, load_all

    load_all()
    files = REGISTRY["v15_dictionary_search"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
