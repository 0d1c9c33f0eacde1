"""Site features, ranked sites, rooms, TF-IDF and exact dedup against plain versions."""
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import sites as SI
from quarry.operators import textops as TX
from quarry.plans.sites_q import FEATURES


def test_site_features_and_drivers(spark):
    rng = random.Random(6)
    rows = [("s", f"t{rng.randrange(8)}", *[float(rng.choice([0, 0, 1, 5, rng.randrange(60)])) for _ in FEATURES]) for _ in range(120)] + [("s", "alone", *[0.0] * len(FEATURES))]
    df = spark.createDataFrame(rows, "study_id string, site_id string, " + ", ".join(f"{c} double" for c in FEATURES))
    got = {r["site_id"]: r for r in SI.site_features(df, FEATURES).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(dict(zip(FEATURES, r[2:])))
    for site, own in by.items():
        g, total = got[site], {c: sum(p[c] for p in own) for c in FEATURES}
        for c in FEATURES:
            v = [p[c] for p in own]
            assert abs(g[f"{c}_sum"] - total[c]) < 1e-9 and g[f"{c}_max"] == max(v) and abs(g[f"{c}_mean"] - np.mean(v)) < 1e-9
            assert g[f"{c}_std"] is None if len(v) == 1 else abs(g[f"{c}_std"] - np.std(v, ddof=1)) < 1e-9
        assert abs(g["issue_density"] - sum(total[c] for c in FEATURES if "issue" in c) / len(own)) < 1e-9
        sdv = total["forms_verified"] / ((total["crfs_require_verification_sdv"] + total["forms_verified"]) or 1) * 100
        assert abs(g["sdv_completion_rate"] - sdv) < 1e-9 and abs(g["log_patient_count"] - math.log1p(len(own))) < 1e-9
    s = SI.site_features(df, FEATURES)
    ranked = SI.ranked_sites(s.withColumn("risk", SI.site_risk(s)), "risk", 4).collect()
    cut = np.quantile([r["issue_density"] for r in got.values()], 0.75)
    score = {k: r["issue_density"] * 10 + r["query_density"] * 5 + r["has_sae_pending"] * 20 + (100 - r["sdv_completion_rate"]) * 0.2 + (100 - r["meddra_completion_rate"]) * 0.1 for k, r in got.items()}
    assert [r["site_id"] for r in ranked] == sorted(score, key=lambda k: -score[k])[:4] and [r["risk_rank"] for r in ranked] == [1, 2, 3, 4]
    for r in ranked:
        assert ("High Issue Density" in r["primary_drivers"]) <= (got[r["site_id"]]["issue_density"] > cut) and r["primary_drivers"].count(",") <= 2
        assert abs(r["confidence_band"] - np.std(list(score.values()), ddof=1) / 2) < 1e-9


def test_rooms(spark):
    rows = [(1, 0, "user", "What now? "), (1, 1, "assistant", "Yes, go on."), (1, 2, "assistant", "yesterday"), (1, 3, None, None), (None, 0, "user", "x"), (None, 1, "user", "y?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["room"]: r for r in SI.room_summary(df).collect()}
    assert (got[1]["messages"], got[1]["members"], got[1]["questions"], got[1]["votes"], got[1]["last_turn"]) == (4, 2, 1, 1, 3)
    assert (got[None]["messages"], got[None]["members"], got[None]["questions"]) == (2, 1, 1)
    stats = {(r["measure"], r["key"]): r["value"] for r in SI.room_statistics(df).collect()}
    assert stats["overall", "rooms"] == 2 and stats["role", "none"] == 1 and stats["length", "short"] == 1 and stats["members", "2"] == 1


def test_tfidf_equals_plain_counts(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "x", "delta", "eps", "a1", "be-ta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    counts = []
    for t in texts:
        w = [x for x in re.findall("[a-z0-9_]+", (t or "").lower()) if len(x) >= 2]
        counts.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    total = Counter()
    for c in counts:
        total.update(c)
    vocab = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:20]}
    seen = Counter(t for c in counts for t in c if t in vocab)
    want = {(i, t): (n, n * math.log((len(texts) + 1) / (seen[t] + 1))) for i, c in enumerate(counts) for t, n in c.items() if t in vocab}
    index = TX.tfidf_index(df, vocab=20)
    got = {(r["doc_id"], r["term"]): (r["tf"], r["weight"]) for r in index.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    for r in TX.strongest_terms(index).collect():
        own = [(-round(w, 9), t) for (i, t), (_, w) in want.items() if i == r["doc_id"]]
        assert (r["indexed_terms"], r["top_term"]) == (len(own), min(own)[1])


def test_exact_dedup_with_repeated_ids(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c"), (None, "c"), (3, None), (4, None), (1, "a")]
    got = TX.dedup_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", 4), (1, "b", 1), (None, "c", 2), (3, None, 2)], key=str)


_ODD = ["a", "Bé", "Dr.", "xDr.", "_Mr.", "éMs.", "-́etc.", "²Inc.", "e.g.", "i.e.", "Z.", "!", "?", ".", " ", "  ", "\t", "\n", "\n\n", "\n\n\n\n", "\r", "\x0b", "\x1c", "\x00", "\x01", "\x85", " ", " ", " ", "　", "😀", "word " * 9]


def test_chunk_loop_parts_texts_as_the_expressions_do(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(_ODD) for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select("id", TX.split_sentences(F.col("t")).alias("s"), TX.clean_text(F.col("t")).alias("c"), TX.split_paragraphs(F.col("t")).alias("p"),
                    TX.chunk_texts(F.col("t"), 10 ** 6).alias("whole"), TX._chunk_rows(F.col("t"), 40, 10, 0).alias("rows")).collect()
    for r in got:
        assert TX._sentences(texts[r.id]) == r.s and r.whole == ([r.c] if r.c else [])
        assert [p for p in map(TX._strip, TX._PARAGRAPH.split(texts[r.id])) if p] == r.p
    rows = df.select("id", F.explode(TX._chunk_rows(F.col("t"), 40, 10, 0)).alias("x")).select("x.words", TX.word_count(F.col("x.text")).alias("n")).collect()
    assert len(rows) > 600 and all(r.words == r.n for r in rows)


def test_chunks_of_a_very_long_text_take_no_time_with_its_square(spark):
    n = 100_000
    df = spark.createDataFrame([(0, " ".join(f"Sentence {i} ends here." for i in range(n)))], "id int, t string")
    df.select(TX.chunk_texts(F.col("t"))).limit(0).collect()
    start = time.monotonic()
    chunks = df.select(TX.chunk_texts(F.col("t")).alias("c")).first().c
    assert time.monotonic() - start < 15
    assert chunks[-1].endswith(f"Sentence {n - 1} ends here.") and all(len(c) < 600 for c in chunks)  # separators are not counted
