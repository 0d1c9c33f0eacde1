"""Sections, entity context, hypotheses and JSON properties against plain versions."""
import json
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import hypotheses as HY
from quarry.operators import jsondata as JS
from quarry.operators import sections as SE


# sections


def plain_sections(text):
    """The same by one pass over the lines with a stack of headings."""
    out, stack, at = [], [], 0
    for line in text.split("\n"):
        level = None
        if re.match(r"^#{1,6}\s+\S.*$", line):
            level = len(re.match("^#+", line)[0])
        elif m := re.match(r"^(\d+(?:\.\d+)*)[.)]?\s+[A-Z].*$", line):
            level = min(6, m[1].count(".") + 1)
        elif re.match(r"^[A-Z][A-Z\s()-]{5,}:?\s*$", line):
            level = 1
        if level:
            title = re.sub(r"^(?:#{1,6}|\d+(?:\.\d+)*[.)]?)\s+", "", line).strip(" ").removesuffix(":")
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
            out.append([level, title, [t for _, t in stack], at, [line]])
        elif out:
            out[-1][4].append(line)
        else:
            out.append([None, None, [], 0, [line]])
        at += len(line) + 1
    return [(lv, t, p, a, a + len("\n".join(lines)), "\n".join(lines)) for lv, t, p, a, lines in out]


def test_sections_equal_a_plain_parser_and_lose_nothing(spark):
    rng = random.Random(4)
    lines = ["# One", "## Two deep", "### Three", "###### Six", "1 Intro", "1.2 Part Of It", "1.2.3.4.5.6.7 Far Down", "2) Next", "SAFETY PLAN (A):", "text of it", "", "  indented", "1.2 lower case", "#nothing", "é 😀 more", "ABC"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25))) for _ in range(150)] + ["# Only", "\n", "no headings\nat all", "word " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string").repartition(5)
    got = defaultdict(list)
    for r in SE.sections(df).orderBy("doc_id", "section").collect():
        got[r["doc_id"]].append((r["level"], r["title"], r["path"], r["from"], r["to"], r["text"]))
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i] == plain_sections(t), t
        assert "\n".join(s[5] for s in got[i]) == t and all(t[a:z] == s for _, _, _, a, z, s in got[i])
    chunks = defaultdict(list)
    for r in SE.section_chunks(df).orderBy("doc_id", "section", "chunk_index").collect():
        chunks[r["doc_id"], r["section"]].append(r["chunk"])
    for i, t in enumerate(texts):
        for s in plain_sections(t):
            own = [c for (d, n), c in chunks.items() if d == i]
            assert sum(map(len, own)) > 0
            if len(s[5]) <= 750:
                assert any(s[5] in c for c in own)


# context


def test_context_equals_plain_grouping(spark):
    rng = random.Random(2)
    tables = {k: [(rng.choice(["hot"] * 8 + ["a", "b"]), rng.choice([None, 1.0, 2.0, rng.random()]), f"{k}{rng.randrange(400)}") for _ in range(600)] for k in ("issues", "notes", "alerts")}
    tables["alerts"] = [r for r in tables["alerts"] if r[0] != "b"]
    frames = {k: spark.createDataFrame(v, "entity string, rank double, text string").repartition(4) for k, v in tables.items()}
    got = {r["entity"]: r for r in SE.entity_context(frames, 3).collect()}
    for e in ("hot", "a", "b"):
        parts, n = [], 0
        for k, rows in tables.items():
            own = sorted((r[1] is None, -(r[1] or 0), r[2]) for r in rows if r[0] == e)
            if own:
                parts.append(f"{k} ({len(own)}): " + "; ".join(t for _, _, t in own[:3]))
                n += len(own)
        assert (got[e]["fragments"], got[e]["kinds"], got[e]["context"]) == (n, len(parts), "\n".join(parts))


# hypotheses


def plain_hypotheses(p, study, kind, count, severity, total, tier):
    e = [(1.0, 0.5)]
    if count > 0:
        e.append((0.3 if count <= 2 else 0.6 if count <= 5 else min(count / 10, 1.0), 0.8))
    if severity > 0:
        e.append((min(severity, 1.0), 0.7))
    if total > 1:
        e.append((min(total / 5, 0.8), 0.4))
    if tier in ("critical", "high"):
        e.append((0.9 if tier == "critical" else 0.7, 0.6))
    if kind in config.HYPOTHESIS_SPECIAL_EVIDENCE and count > config.HYPOTHESIS_SPECIAL_EVIDENCE[kind][0]:
        e.append(config.HYPOTHESIS_SPECIAL_EVIDENCE[kind][1:])
    if len(e) < 2:
        return
    sure = min(sum(d * w for d, w in e) / sum(w for _, w in e) + min(0.2, 0.04 * len(e)), 1.0)
    margin = 0.15 / math.sqrt(len(e))
    for t, cause, base, check in config.HYPOTHESIS_TEMPLATES:
        if t == kind:
            c = round(sure, 3)
            if kind.startswith("sae_"):
                priority = "Critical" if c >= 0.5 else "High"
            else:
                priority = "Low" if c < 0.3 else ("Medium" if base in ("Critical", "High") else "Low") if c < 0.5 else "High" if c < 0.7 and base == "Critical" else base
            advice = ([f"VERIFY FIRST: {check}"] if c < 0.5 else []) + config.HYPOTHESIS_ADVICE.get(kind, []) + [a for words, a in config.HYPOTHESIS_CAUSE_ADVICE if any(w in cause for w in words)]
            advice = (advice + [config.HYPOTHESIS_DEFAULT_ADVICE] if len(advice) < 2 else advice)[:4]
            yield p, kind, cause, len(e), c, round(max(0.0, sure - margin), 3), round(min(1.0, sure + margin), 3), priority, tuple(advice)


def test_hypotheses_equal_plain_ones(spark):
    rng = random.Random(3)
    kinds = sorted({t[0] for t in config.HYPOTHESIS_TEMPLATES})
    rows = [(f"p{i}", "s", rng.choice(kinds), float(rng.choice([0, 1, 2, 3, 4, 6, 20])), rng.choice([0.0, 0.21, 0.4, 3.0]), rng.randrange(1, 9), rng.choice(["critical", "high", "low", "none"])) for i in range(500)]
    df = spark.createDataFrame(rows, "patient_key string, study_id string, issue_type string, issue_count double, severity double, total_issues int, priority_tier string")
    found = HY.hypotheses(df)
    got = sorted((r["patient_key"], r["issue_type"], r["root_cause"], r["n_evidence"], r["confidence"], r["low"], r["high"], r["priority"], tuple(r["recommendations"])) for r in found.collect())
    want = sorted(h for r in rows for h in plain_hypotheses(*r))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[7:] == w[7:] and all(abs(a - b) < 0.0011 for a, b in zip(g[4:7], w[4:7]))
    bands = Counter((h[1], h[2], "high" if h[4] >= 0.7 else "medium" if h[4] >= 0.4 else "low") for h in got)
    assert {(r["issue_type"], r["root_cause"], r["band"]): r["hypotheses"] for r in HY.hypothesis_counters(found).collect()} == bands


def test_chain_confidence(spark):
    rows = [("a", "strong", True)] * 3 + [("a", "weak", False)] + [("b", "strong", False)] * 2 + [("c", "moderate", True), ("c", "unknown", True)]
    got = {r["chain"]: r for r in HY.chain_confidence(spark.createDataFrame(rows, "chain string, strength string, supports boolean"), "chain").collect()}
    a = (3.0 - 0.4) / 4
    assert abs(got["a"]["confidence"] - (a + 1) / 2) < 1e-9 and got["a"]["strength"] == "strong" and abs(got["a"]["low"] - ((a + 1) / 2 - 0.075)) < 1e-9
    assert (got["b"]["confidence"], got["b"]["strength"]) == (0.0, "inconclusive") and abs(got["c"]["confidence"] - (0.7 / 2 + 1) / 2) < 1e-9


# JSON


def test_json_round_trip(spark):
    docs = [{"a": 1, "b": "x\"y é😀", "c": True, "d": None, "e": [1, {"f": "g"}], "h": {"i": 2.5, "j": [None]}, "k\"ey": "v", "big": 12345678901, "s": "12"}, {}, {"only": "text"}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(7, "not json"), (8, None), (9, "{\"a\": }"), (10, "[1, 2]"), (11, "3")]
    good, bad = JS.parsed(spark.createDataFrame(rows, "id int, props string"), "props")
    assert sorted(r["id"] for r in bad.collect()) == [7, 8, 9] and {r["props"] for r in bad.collect()} == {"not json", None, "{\"a\": }"}
    flat = JS.clean_metadata(good, "id", "props")
    got = {(r["id"], r["key"]): (r["kind"], r["value"]) for r in flat.collect()}
    assert got[0, "b"] == ("STRING", "x\"y é😀") and got[0, "c"] == ("BOOLEAN", "true") and got[0, "a"] == ("BIGINT", "1") and (0, "d") not in got
    assert json.loads(got[0, "e"][1]) == [1, {"f": "g"}] and got[0, "e"][0] == "ARRAY" and got[0, "h"][0] == "OBJECT"
    back = {r["id"]: json.loads(r["json"]) for r in JS.packed(flat, "id").collect()}
    assert back == {0: {k: v for k, v in docs[0].items() if v is not None}, 2: docs[2]}
    one = JS.describe(good, bad, "props").first()
    assert (one["documents"], one["invalid"]) == (8, 3) and one["schema"]
    assert good.select(F.try_variant_get("props", "$.h.i", "double").alias("v")).where("v IS NOT NULL").collect()[0]["v"] == 2.5
