"""Hand-computed frames and brute-force twins for the tricky operators."""
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions.exprs import argmax_name, pct_rank_avg, top_n_text
from quarry.functions.ranking import histogram_rank
from quarry.operators import alerts as AL
from quarry.operators import cleaning as CL
from quarry.operators import governance as G
from quarry.operators import graph


def test_normalize_header():
    assert CL.normalize_header(["Subject ID", " Subject  Name\n", "Site#", "", "Subject ID "]) == \
        ["subject_id", "subject_name", "site", "unnamed", "subject_id_1"]


def test_id_standardisation(spark):
    rows = [("site 12", "subj-7", "Screen Fail"), ("Site_12", "Subject 7", "screening failure"),
            ("SITE-12", "7", "survival follow-up"), ("", "nan", "nonsense"), (None, None, None)]
    df = spark.createDataFrame(rows, "site string, subject string, status string")
    out = df.select(CL.std_site(F.col("site")).alias("s"), CL.std_subject(F.col("subject")).alias("u"),
                    CL.std_status(F.col("status")).alias("st")).collect()
    assert [r.s for r in out] == ["Site_12", "Site_12", "Site_12", None, None]
    assert [r.u for r in out] == ["Subject_7", "Subject_7", "Subject_7", None, None]
    assert [r.st for r in out] == ["Screen Failure", "Screen Failure", "Ongoing", "Unknown", "Unknown"]


def test_study_and_dates(spark):
    df = spark.createDataFrame([("Study 12 (EDC)", "15-Jan-2024"), ("abc", "01/15/2024"), (None, "2024-01-15T10:30:00"),
                                ("None", "garbage")], "p string, d string")
    out = df.select(CL.std_study(F.col("p")).alias("s"), CL.parse_date_multi(F.col("d")).alias("t")).collect()
    assert [r.s for r in out] == ["Study_12", "abc", "Unknown", "Unknown"]
    assert out[0].t == dt.datetime(2024, 1, 15) and out[1].t == dt.datetime(2024, 1, 15)
    assert out[2].t == dt.datetime(2024, 1, 15, 10, 30) and out[3].t is None


def test_junk_and_invalid(spark):
    df = spark.createDataFrame([("Study 1", "Responsible LF for action"), ("Study 1", "nan"), ("Study 1", "7"),
                                ("Study 1", ""), ("Study 1", None)], "project_name string, subject string")
    out = CL.drop_invalid_subjects(CL.drop_junk_rows(df)).collect()
    assert [r.subject for r in out] == ["7"]


def test_pct_rank_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 200), "v": rng.integers(0, 15, 200).astype(float)})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf.reset_index())
    got = df.select("index", pct_rank_avg(F.col("v"), ["g"]).alias("p")).toPandas().set_index("index").sort_index()
    exp = pdf.groupby("g")["v"].rank(pct=True)
    assert np.allclose(got["p"].fillna(-1), exp.fillna(-1))
    h = histogram_rank(df, "v", ["g"]).toPandas().set_index("index").sort_index()
    assert np.allclose(h["v_pct"].fillna(-1), exp.fillna(-1))
    assert (h["v_rank_min"].dropna() == pdf.groupby("g")["v"].rank(method="min").dropna()).all()


def test_argmax_and_top_text(spark):
    df = spark.createDataFrame([(3.0, 5.0, 5.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    out = df.select(argmax_name([("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))], 0.0, "none").alias("m"),
                    top_n_text([("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))], 2).alias("t")).collect()
    assert out[0].m == "b" and out[0].t == "b:5; c:5"
    assert out[1].m == "none" and out[1].t == ""


def _brute_dedup(rows, window):
    kept, last = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if k in last and t - last[k] <= window:
            kept[i] = False
        else:
            kept[i] = True
            last[k] = t
    return kept


def test_dedup_matches_greedy_scan(spark):
    random.seed(3)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        k = random.choice(["a", "b", "c"])
        t = base + dt.timedelta(minutes=random.choice([random.randint(0, 3000), 60 * random.randint(0, 50)]))
        rows.append((k, i, t))
    df = spark.createDataFrame(rows, "dedup_key string, alert_id long, created_at timestamp_ntz")
    got = {r.alert_id: r.kept for r in AL.dedup_kept(df).collect()}
    assert got == _brute_dedup(rows, dt.timedelta(minutes=60))


def test_fatigue_matches_brute_force(spark):
    random.seed(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(800):
        t = base + dt.timedelta(minutes=random.randint(0, 60 * 30))
        rows.append((i, t, random.choice([1, 2]), random.choice(["urgent", "normal", "low"]),
                     random.choice(["safety", "task"])))
    df = spark.createDataFrame(rows, "alert_id long, created_at timestamp_ntz, recipient_id long, priority string, "
                                     "category string")
    got = {r.alert_id: r.suppressed for r in AL.fatigue_filter(df, per_hour=5, per_day=30).collect()}
    exp = {}
    for rcp in (1, 2):
        kept = []
        for i, t, r, p, c in sorted([x for x in rows if x[2] == rcp], key=lambda x: (x[1], x[0])):
            exempt = p == "urgent" or c == "safety"
            h = sum(1 for x in kept if x >= t - dt.timedelta(hours=1))
            d = sum(1 for x in kept if x >= t - dt.timedelta(days=1))
            if not exempt and (h >= 5 or d >= 30):
                exp[i] = True
            else:
                exp[i] = False
                kept.append(t)
    assert got == exp


def test_pagerank_matches_power_iteration(spark):
    nodes, edges = graph.dependency_graph(spark)
    names = [r.node for r in nodes.collect()]
    e = [(r.dst, r.src) for r in edges.collect()]  # reversed
    n = len(names)
    idx = {x: i for i, x in enumerate(names)}
    out = {}
    for s, d in e:
        out.setdefault(s, []).append(d)
    x = np.full(n, 1.0 / n)
    for _ in range(100):
        new = np.zeros(n)
        for s, ds in out.items():
            for d in ds:
                new[idx[d]] += 0.85 * x[idx[s]] / len(ds)
        dang = sum(x[idx[v]] for v in names if v not in out)
        new += 0.85 * dang / n + 0.15 / n
        err = np.abs(new - x).sum()
        x = new
        if err < n * 1e-6:
            break
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    got = {r.node: r.pagerank for r in graph.pagerank(nodes.select("node"), rev).collect()}
    assert all(abs(got[v] - x[idx[v]]) < 1e-9 for v in names)


def test_previous_in_order_is_global_lag(spark):
    pdf = pd.DataFrame({"t": np.random.default_rng(2).permutation(500), "v": np.arange(500)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = G.previous_in_order(df, ["t"], "v", "prev").toPandas().sort_values("t")
    exp = pdf.sort_values("t")["v"].shift(1)
    assert np.allclose(got["prev"].fillna(-1).to_numpy(), exp.fillna(-1).to_numpy())


def test_drift_alert_severity(spark):
    cur = spark.createDataFrame([(0.5, 0.20, 0.4, 0.5)], "overall_accuracy double, expected_calibration_error double, "
                                                         "acceptance_rate double, rejection_rate double")
    base = spark.createDataFrame([(0.8, 0.05, 0.6, 0.2)], cur.schema)
    got = {r.metric_name: r.severity for r in G.drift_alerts(cur, base).collect()}
    # accuracy drop .375 / .10 -> critical; ece +.15 / .05 -> critical; acceptance drop .333 / .15 -> high;
    # rejection spike 1.5 / .2 -> critical
    assert got == {"overall_accuracy": "critical", "expected_calibration_error": "critical",
                   "acceptance_rate": "high", "rejection_rate": "critical"}


def test_governance_decisions(spark):
    from quarry.operators import decisions as D
    rows = [("db_lock", "lock it", "site", ["ops"], 0.99), ("sae_dm_pending", "SAE reconciliation", "sae", ["x"], 0.97),
            ("open_queries", "Resolve query", "query", ["routine"], 0.96), ("open_queries", "Resolve query", "query",
                                                                              ["modify_locked"], 0.5)]
    df = spark.createDataFrame(rows, "action_type string, description string, entity_type string, tags array<string>, "
                                     "confidence double")
    out = D.decide(df).collect()
    assert (out[0].is_prohibited, out[0].action_decision, out[0].approval_level, out[0].approvers_required) == \
        (True, "block", "sponsor", 2)
    assert (out[1].risk_level, out[1].action_decision) == ("critical", "escalate")
    assert (out[2].risk_level, out[2].action_decision, out[2].approval_expiry_hours) == ("medium", "auto_draft", 72)
    assert (out[3].is_prohibited, out[3].prohibited_type) == (True, "locked_data_change")


def test_stream_fatigue_equals_batch(spark):
    from quarry.plans.collab_q import _alerts
    from quarry.streaming import alerts_stream as ST
    from tests.conftest import SF_SMALL
    batch = {r.alert_id: r.suppressed for r in AL.fatigue_filter(_alerts(spark, SF_SMALL)).collect()}
    stream = {r.alert_id: r.suppressed for r in ST.fatigue_stream(ST.alert_stream(spark, SF_SMALL)).collect()}
    assert batch == stream


def test_chunking(spark):
    from pyspark.sql import functions as F
    from quarry.operators.textops import chunk_texts
    long_para, short, exclaim = "Dr. Smith saw the patient. " * 40, "Short para.", "Another sentence here! " * 30
    text = long_para + "\n\n" + short + "\n\n\n\n" + exclaim
    rows = spark.createDataFrame([(0, text), (1, "tiny"), (2, "   "), (3, None), (4, "x" * 2000), (5, "A b. " * 300)], "id int, t string")
    got = {r.id: r.c for r in rows.select("id", chunk_texts(F.col("t")).alias("c")).collect()}
    assert got[1] == ["tiny"] and got[2] == got[3] == []
    assert got[4] == ["x" * 2000]  # one sentence has no inner cut
    sentence = "Dr. Smith saw the patient."
    n = 500 // len(sentence)  # whole sentences up to the size
    assert got[0][0] == " ".join([sentence] * n)
    assert got[0][1].startswith(sentence) and all(150 <= len(c) <= 500 + 200 for c in got[0])
    # a third of a chunk's sentences comes again in the next one
    assert sum(c.count(sentence) for c in got[0]) > 40 and got[0][-1].endswith("Another sentence here!")
    assert all(set(c.split()) <= {"A", "b."} for c in got[5])


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_row_numbers_and_carries_over_many_ranges(spark, partitions):
    from quarry.operators import ml
    pdf = pd.DataFrame({"k": np.arange(4000), "g": np.arange(4000) % 3, "t": np.random.default_rng(3).permutation(4000), "extra": "x"})
    pdf.loc[::7, "g"] = 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(pdf).repartition(partitions)
        got = ml.ordered_row_number(df, ["g"], ["t"], "rn").toPandas().sort_values("k")
        assert (got["rn"].to_numpy() == pdf.groupby("g")["t"].rank().astype(int).to_numpy()).all() and list(got.columns) == [*pdf.columns, "rn"]
        lag = G.previous_in_order(df, ["t"], "k", "prev").toPandas().sort_values("t")
        assert np.allclose(lag["prev"].fillna(-1), pdf.sort_values("t")["k"].shift(1).fillna(-1)) and len(lag) == 4000
        more = __import__("quarry.operators.reports", fromlist=["oversample"]).oversample(df, "g", "k")
        assert more.groupBy("g").count().select("count").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_chain_graphs(spark):
    from quarry.operators import graph, impact
    n = 70  # longer than the fixed number of rounds there once was
    names = [f"n{i:03d}" for i in range(n)]
    edges = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])] + [(names[0], names[2])], "src string, dst string")
    short = {r.start: r for r in graph.shortest_paths_to(edges, names[-1]).collect()}
    assert len(short) == n - 1 and short[names[0]].path == [names[0], *names[2:]] and short[names[1]].length == n - 1
    n, names = 12, names[:12]  # many rounds of several jobs each
    edges = edges.filter(F.col("dst") <= names[-1])
    weights = spark.createDataFrame([(x, 1) for x in names], "node string, count long")
    heavy = {r.start: r for r in graph.heaviest_paths_to(edges, weights, names[-1]).collect()}
    assert heavy[names[0]].path == names and heavy[names[0]].weight == n - 1
    with pytest.raises(ValueError):
        graph.heaviest_paths_to(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "z")], "src string, dst string"), spark.createDataFrame([("a", 1), ("b", 1)], "node string, count long"), "z")
    assert graph.reachable(edges, spark.createDataFrame([(names[0],)], "node string")).count() == n - 1
    days = spark.createDataFrame([(x, 1.0) for x in names], "node string, duration double")
    plan = impact.schedule(spark, days, {a: [b] for a, b in zip(names, names[1:])})
    assert plan.filter("critical").count() == n and plan.agg({"earliest_finish": "max"}).first()[0] == n


@pytest.mark.parametrize("files", [1, 4])
def test_streams_read_folders_and_lose_nothing(spark, files, tmp_path):
    from pyspark.sql import functions as F
    from quarry.streaming import alerts_stream as ST
    from tests.conftest import SF_SMALL
    ev = spark.read.parquet(SF_SMALL + "/events.parquet")
    n = ev.count()
    ev.repartition(files, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    sf = str(tmp_path)
    table = str(tmp_path / "days")
    ST.daily_upsert(ST.event_stream(spark, sf), table)
    assert ST.daily_totals(spark, table).agg(F.sum("events")).first()[0] == n
    assert ST.all_usage_sessions(spark, sf).agg(F.sum("events")).first()[0] == n
    assert ST.all_hourly_counts(spark, sf).agg(F.sum("alerts")).first()[0] == n
    assert ST.dedup_stream(ST.alert_stream(spark, sf)).count() == n


def test_appended_and_flushed_windows_are_those_of_a_batch(spark, tmp_path):
    """Both parts are there, and together they are what a batch over all input gives."""
    from pyspark.sql import functions as F
    from quarry.streaming import alerts_stream as ST
    from tests.conftest import SF_SMALL
    spark.read.parquet(SF_SMALL + "/events.parquet").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "events.parquet"))
    sf = str(tmp_path)
    whole = ST.usage_sessions(ST.event_stream(spark, sf, stream=False))
    rows = lambda df: sorted(map(tuple, df.select("user_id", "session_start", "session_end", "events", F.round("value", 6)).collect()), key=str)
    assert rows(ST.all_usage_sessions(spark, sf)) == rows(whole)
    appended = ST.run_to_parquet(ST.usage_sessions(ST.event_stream(spark, sf)), "appended").count()
    assert 0 < appended < whole.count()
    counts = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert counts(ST.all_hourly_counts(spark, sf)) == counts(ST.hourly_counts(ST.alert_stream(spark, sf, stream=False)))


def test_escalation_timeline_matches_simulation(spark):
    from quarry import config
    from quarry.operators import collab
    random.seed(11)
    base = dt.datetime(2001, 1, 1)
    rows = [(i, random.choice(["critical", "high", "medium", "low"]), random.choice(["sae_dm_pending", "open_queries"]),
             random.choice(["open", "in_progress", "resolved"]), base + dt.timedelta(hours=random.randint(0, 2000)))
            for i in range(150)]
    df = spark.createDataFrame(rows, "issue_id long, priority string, category string, status string, created_at timestamp_ntz")
    until = dt.datetime(2001, 4, 1)
    got = {(r.issue_id, r.rule_id): r.fired for r in collab.escalation_timeline(df, until).collect()}
    exp = {}
    epoch = dt.datetime(1970, 1, 1)
    for iid, pr, cat, st, created in rows:
        if st not in config.ESCALATION_DEFAULT_STATUSES:
            continue
        cand = []
        for rid, lvl, trig, hrs, prios, cats in config.ESCALATION_RULES:
            if prios and pr not in prios or cats and cat not in cats:
                continue
            el = created + dt.timedelta(hours=hrs if trig == "time_based" else 0)
            us = int((el - epoch).total_seconds() * 1_000_000)
            check = -(-us // 86_400_000_000)
            if check * 86_400_000_000 <= int((until - epoch).total_seconds() * 1_000_000):
                cand.append((check, rid, lvl))
        highest = 0
        for check in sorted({c for c, _, _ in cand}):
            now = [(rid, lvl) for c, rid, lvl in cand if c == check]
            fired = [(rid, lvl) for rid, lvl in now if lvl > highest]
            for rid, lvl in now:
                exp[(iid, rid)] = (rid, lvl) in fired
            highest = max([highest] + [lvl for _, lvl in fired])
    assert got == exp


def test_leakage_check():
    from quarry.operators.ml import leakage_check
    assert leakage_check(["a", "b", "c"], ["c", "d"]) == ["c"]
    assert leakage_check(["a"], []) == []


def test_record_plan_pushes_filters_and_prunes_columns(spark):
    """The fused lineitem scan must carry the OR of the detail predicates as
    a pushed filter and read only the eight columns it uses."""
    from quarry.operators import record
    from tests.conftest import SF_SMALL
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = record.build_record(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    li = [line for line in plan.split("\n") if "lineitem" in line and "FileScan" in line]
    assert li, plan
    assert "PushedFilters: [Or(" in li[0]
    schema = li[0].split("ReadSchema: struct<")[1].split(">")[0]
    assert schema.count(":") == 8 and "l_extendedprice" not in schema


def test_exact_quantiles(spark):
    from quarry.functions.quantiles import exact_quantiles
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": r.normal(size=3001), "b": np.exp(r.normal(size=3001) * 40), "c": r.integers(0, 3, 3001).astype(float), "d": 7.0, "e": np.nan})
    pdf.loc[::5, "a"] = None
    qs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, e double").repartition(6)
    got = exact_quantiles(df, list(pdf.columns), qs)
    for c in "abcd":
        assert np.allclose(got[c], pdf[c].dropna().quantile(qs).to_numpy(), rtol=1e-12)
    assert got["e"] == [None] * len(qs)


def test_vector_topk_in_blocks(spark):
    from quarry.operators import vector as VX
    r = np.random.default_rng(6)
    m = r.normal(size=(300, 8))
    m[200:] = m[:100]  # ties
    corpus = spark.createDataFrame([(i, [float(x) for x in v], "g%d" % (i % 2)) for i, v in enumerate(m)], "vec_id long, embedding array<double>, g string").repartition(5)
    q = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(20)], "query_id long, qvec array<double>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    one = key(VX.cosine_topk(corpus, q, 7))
    assert one == key(VX.cosine_topk(corpus, q, 7, block_bytes=300))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for row in q.collect():
        s = unit @ (np.array(row["qvec"]) / np.linalg.norm(row["qvec"]))
        want = sorted(range(300), key=lambda i: (-round(s[i], 12), i))[:7]
        assert [x[2] for x in one if x[0] == row["query_id"]] == want
    assert VX.cosine_topk(corpus, q.limit(0), 7).count() == 0
