"""The driver's TPC-H-style tables seen as trial data.

region -> study, nation -> site, customer -> subject.  Detail rows are
narrow slices of orders / lineitem / events chosen so that a patient has a
handful of rows (0-5 typically).  Predicates are SQL text so the Spark plan
(via `F.expr`) and the DuckDB oracle share one definition of the mapping;
the operators on top are written independently on each side.

Scale notes: every lineitem-derived counter is computed in ONE filtered scan
of lineitem (filters reach the parquet reader), joined once to the two
needed columns of orders, and aggregated once per patient with map-side
partial aggregation.  orders and events are each scanned once as well.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import detail
from quarry.sources.tables import load

# ---------------------------------------------------------------------------
# Mapping predicates (SQL text shared with the oracle)
# ---------------------------------------------------------------------------
LINE_PRED = {
    "pages": "l_linestatus = 'O' AND l_quantity >= 49",
    "query": "l_returnflag = 'R' AND l_discount >= 0.10",
    "coding": "l_tax = 0.08",
    "never_signed": "l_linestatus = 'O' AND l_returnflag = 'N' AND l_discount = 0.0",
    "broken_sig": "l_returnflag = 'A' AND l_discount = 0.10 AND l_quantity <= 10",
    "overdue_sig": "l_linestatus = 'O' AND l_tax = 0.0 AND l_shipdate >= TIMESTAMP '2000-01-01 00:00:00'",
    "sdv": "l_linestatus = 'F' AND l_discount = 0.05",
}
# query kind by line number
QUERY_KINDS = {
    "dm_queries": "l_linenumber IN (1, 2)",
    "clinical_queries": "l_linenumber IN (3, 4)",
    "medical_queries": "l_linenumber = 5",
    "site_queries": "l_linenumber = 6",
    "safety_queries": "l_linenumber = 7",
}
ORDER_PRED = {
    "visit": "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'",
    "sae": "o_orderpriority = '2-HIGH'",
    "inactivated": "o_orderstatus = 'O' AND o_orderpriority = '5-LOW'",
}
EVENT_PRED = {
    "edrr": "event_type = 'error'",
    "lab": "event_type = 'purchase' AND value >= 100",
}


def _e(sql: str) -> Column:
    return F.expr(sql)


def _any(preds) -> Column:
    out = None
    for p in preds:
        out = _e(p) if out is None else (out | _e(p))
    return out


def _days_since(ts: str, as_of: dt.date) -> Column:
    return F.datediff(F.lit(as_of), F.to_date(F.col(ts)))


def status_from_segment(seg: Column) -> Column:
    expr = None
    for k, v in config.SEGMENT_TO_STATUS.items():
        expr = F.when(seg == k, v) if expr is None else expr.when(seg == k, v)
    return expr.otherwise("Unknown")


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject: ids, region, country, status (cpid extract)."""
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    s = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    study = F.concat(F.lit("Study_"), F.col("r_regionkey").cast("string"))
    site = F.concat(F.lit("Site_"), F.col("c_nationkey").cast("string"))
    subj = F.concat(F.lit("Subject_"), F.col("c_custkey").cast("string"))
    return s.select(
        F.col("c_custkey").alias("subject_key"),
        F.concat_ws("|", study, site, subj).alias("patient_key"),
        study.alias("study_id"), site.alias("site_id"), subj.alias("subject_id"),
        F.col("r_name").alias("region"), F.col("n_name").alias("country"),
        status_from_segment(F.col("c_mktsegment")).alias("subject_status_clean"),
    )


def line_counters(spark: SparkSession, sf_dir: str, as_of: dt.date = config.AS_OF_STAR) -> DataFrame:
    """Subject counters from lineitem: queries, SDV, signatures, missing
    pages (A5) and coding (A7), one pass."""
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    li = li.filter(_any(LINE_PRED.values()))
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    lo = li.join(o, li.l_orderkey == o.o_orderkey)
    age = _days_since("l_shipdate", as_of)
    q = _e(LINE_PRED["query"])
    coding = _e(LINE_PRED["coding"])
    coding_status = F.when(F.col("l_returnflag") == "N", "UnCoded Term").otherwise("Coded Term")
    odd = (F.col("l_linenumber") % 2) == 1
    ovd = _e(LINE_PRED["overdue_sig"])
    sdv = _e(LINE_PRED["sdv"])
    aggs = [
        F.count(F.when(q, 1)).alias("total_queries"),
        *[F.count(F.when(q & _e(p), 1)).alias(name) for name, p in QUERY_KINDS.items()],
        F.count(F.when(sdv, 1)).alias("crfs_require_verification_sdv"),
        F.count(F.when(sdv & (F.col("l_returnflag") != "R"), 1)).alias("forms_verified"),
        F.count(F.when(_e(LINE_PRED["never_signed"]), 1)).alias("crfs_never_signed"),
        F.count(F.when(_e(LINE_PRED["broken_sig"]), 1)).alias("broken_signatures"),
        F.count(F.when(ovd & (age <= 45), 1)).alias("crfs_overdue_for_signs_within_45_days_of_data_entry"),
        F.count(F.when(ovd & (age > 45) & (age <= 90), 1)).alias(
            "crfs_overdue_for_signs_between_45_to_90_days_of_data_entry"),
        F.count(F.when(ovd & (age > 90), 1)).alias("crfs_overdue_for_signs_beyond_90_days_of_data_entry"),
        *detail.pages_aggs(age, where=_e(LINE_PRED["pages"])),
        *detail.coding_aggs(coding_status, "meddra", where=coding & odd),
        *detail.coding_aggs(coding_status, "whodrug", where=coding & ~odd),
    ]
    return lo.groupBy(F.col("o_custkey").alias("subject_key")).agg(*aggs)


def order_counters(spark: SparkSession, sf_dir: str, as_of: dt.date = config.AS_OF_STAR) -> DataFrame:
    """Missing visits (A1), SAE DM / safety (A3), inactivated forms (A4)."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                                        "o_orderdate"])
    o = o.filter(_any(ORDER_PRED.values()))
    sae = _e(ORDER_PRED["sae"])
    even = (F.col("o_orderkey") % 2) == 0
    review = F.when(F.col("o_orderstatus") == "P", config.SAE_REVIEW_STATUS["P"]) \
        .when(F.col("o_orderstatus") == "F", config.SAE_REVIEW_STATUS["F"]) \
        .otherwise(config.SAE_REVIEW_STATUS["O"])
    form = F.concat(F.lit("Form_"), (F.col("o_orderkey") % 7).cast("string"))
    aggs = [
        *detail.visit_aggs(_days_since("o_orderdate", as_of), where=_e(ORDER_PRED["visit"])),
        *detail.sae_aggs(review, "dm", where=sae & even),
        *detail.sae_aggs(review, "safety", where=sae & ~even),
        *detail.inactivated_aggs(form, where=_e(ORDER_PRED["inactivated"])),
    ]
    return o.groupBy(F.col("o_custkey").alias("subject_key")).agg(*aggs)


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab issues (A2) and EDRR issues (A6) from the event table."""
    ev = load(spark, sf_dir, "events", ["user_id", "event_type", "value"])
    ev = ev.filter(_any(EVENT_PRED.values()))
    aggs = [*detail.lab_aggs(where=_e(EVENT_PRED["lab"])),
            *detail.edrr_aggs(where=_e(EVENT_PRED["edrr"]))]
    return ev.groupBy(F.col("user_id").alias("subject_key")).agg(*aggs)


def edrr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw EDRR rows as the third-party extract delivers them: study and
    subject text, site unknown (so only the study+subject key can match)."""
    ev = load(spark, sf_dir, "events", ["user_id", "event_type"]).filter(_e(EVENT_PRED["edrr"]))
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    x = ev.join(c, ev.user_id == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.select(
        F.concat(F.lit("study "), F.col("n_regionkey").cast("string")).alias("study"),
        F.concat(F.lit("subj-"), F.col("user_id").cast("string")).alias("subject"),
        F.lit(1).cast("long").alias("total_open_issue_count_per_subject"),
    )


# ---------------------------------------------------------------------------
# Raw (uncleaned) extracts: text ids in several spellings, junk and invalid
# rows, duplicated rows, numbers and dates as text.  Fixed values below.
# ---------------------------------------------------------------------------
RAW_STATUS_TEXT = {
    "AUTOMOBILE": ("On Treatment", "Active"),
    "BUILDING": ("Completed", "finished"),
    "FURNITURE": ("Withdrawn", "Discontinued early"),
    "HOUSEHOLD": ("Screening", "screening"),
    "MACHINERY": ("Screen Fail", "Screening Failure"),
}
JUNK_SUBJECT_TEXT = "Responsible LF for action"


def _variant(ck: Column, options: list[Column]) -> Column:
    expr = None
    for i, o in enumerate(options[:-1]):
        cond = (ck % len(options)) == i
        expr = F.when(cond, o) if expr is None else expr.when(cond, o)
    return expr.otherwise(options[-1])


def raw_site_text(ck: Column, nk: Column) -> Column:
    s = nk.cast("string")
    return _variant(ck, [F.concat(F.lit("Site "), s), F.concat(F.lit("SITE-"), s), F.concat(F.lit("site_"), s), s])


def raw_subject_text(ck: Column) -> Column:
    s = ck.cast("string")
    return _variant(ck, [F.concat(F.lit("Subject "), s), F.concat(F.lit("subj-"), s), s])


def raw_cpid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject-level extract as text, before cleaning."""
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    ck, rk = F.col("c_custkey"), F.col("r_regionkey").cast("string")
    project = _variant(ck, [F.concat(F.lit("Study "), rk), F.concat(F.lit("STUDY-"), rk, F.lit(" (EDC)")),
                            F.concat(F.lit("study_"), rk)])
    subject = (F.when(ck % 97 == 1, F.lit(JUNK_SUBJECT_TEXT))
               .when(ck % 89 == 2, _variant(ck, [F.lit("nan"), F.lit("None"), F.lit("")]))
               .otherwise(raw_subject_text(ck)))
    seg = F.col("c_mktsegment")
    status = F.lit("TBD")
    st = None
    for k, (a, b) in RAW_STATUS_TEXT.items():
        v = F.when(ck % 2 == 0, a).otherwise(b)
        st = F.when(seg == k, v) if st is None else st.when(seg == k, v)
    status = F.when(ck % 113 == 5, "TBD").otherwise(st.otherwise("TBD"))
    visit_ts = F.timestamp_add("MINUTE", F.lit(630),
                               F.date_add(F.lit("1995-01-01").cast("date"), (ck % 2000).cast("int")).cast("timestamp_ntz"))
    fmts = [F.date_format(visit_ts, f) for f in config.DATE_FORMATS]
    out = x.select(
        project.alias("project_name"), F.col("r_name").alias("region"), F.col("n_name").alias("country"),
        raw_site_text(ck, F.col("c_nationkey")).alias("site"), subject.alias("subject"),
        status.alias("subject_status"),
        F.when(ck % 31 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("acct_balance"),
        _variant(ck, fmts).alias("latest_visit"), ck.alias("_ck"))
    dup = out.filter(F.col("_ck") % 50 == 3)
    return out.unionByName(dup).drop("_ck")


def raw_order_rows(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """Order-derived detail rows with study / site / subject as text."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                                        "o_orderdate"]).filter(F.expr(where))
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    ck = F.col("c_custkey")
    return x.select(F.concat(F.lit("Study "), F.col("n_regionkey").cast("string")).alias("study"),
                    raw_site_text(ck, F.col("c_nationkey")).alias("site"), raw_subject_text(ck).alias("subject"),
                    "o_orderkey", "o_orderstatus", "o_orderdate")


# ---------------------------------------------------------------------------
# Event-like tables.  Fixed values: category / priority / status mappings.
# ---------------------------------------------------------------------------
EVENT_CATEGORY = {"error": "issue", "click": "task", "view": "report", "signup": "mention", "purchase": "sla_breach"}
ORDER_ISSUE_PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low",
                        "5-LOW": "low"}
ORDER_ISSUE_STATUS = {"O": "open", "P": "in_progress", "F": "resolved"}
STATUS_CYCLE = ["open", "in_progress", "pending_review", "resolved", "closed", "reopened", "escalated", "on_hold",
                "pending_approval", "cancelled"]


def _map(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(F.lit(default))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert stream: one alert per event; k in props gives the key part."""
    ev = load(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    cat = F.when((F.col("event_type") == "error") & (k < 10), "safety").otherwise(
        _map(F.col("event_type"), EVENT_CATEGORY, "system"))
    title = F.when(k % 20 == 0, F.concat(F.lit("URGENT: item "), k.cast("string"))) \
        .when(k % 20 == 1, F.concat(F.lit("Overdue item "), k.cast("string"))) \
        .otherwise(F.concat(F.lit("Update on item "), k.cast("string")))
    return ev.select(F.col("event_id").alias("alert_id"), F.col("ts").alias("created_at"),
                     F.col("user_id").alias("recipient_id"), cat.alias("category"), title.alias("title"),
                     F.concat(F.lit("value "), F.col("value").cast("string")).alias("message"),
                     F.concat(F.col("event_type"), F.lit(":"), (k % 10).cast("string")).alias("dedup_key"),
                     k.alias("k"), F.col("value"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue registry: one issue per order."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
                                        "o_totalprice"])
    types = [t[0] for t in config.ISSUE_TYPES]
    cat = F.get(F.array(*[F.lit(t) for t in types]), (F.col("o_orderkey") % len(types)).cast("int"))
    return o.select(F.col("o_orderkey").alias("issue_id"), F.col("o_custkey").alias("subject_key"),
                    cat.alias("category"), _map(F.col("o_orderpriority"), ORDER_ISSUE_PRIORITY, "low").alias("priority"),
                    _map(F.col("o_orderstatus"), ORDER_ISSUE_STATUS, "open").alias("status"),
                    F.col("o_orderdate").alias("created_at"),
                    F.concat(F.lit("Issue "), F.col("o_orderkey").cast("string")).alias("title"),
                    (F.col("o_custkey") % 50).alias("assignee_id"), F.col("o_totalprice").alias("amount"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue status history: each line of an order is a status change."""
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate"])
    idx = (F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 3).otherwise(0)) % len(STATUS_CYCLE)
    return li.select(F.col("l_orderkey").alias("issue_id"), F.col("l_linenumber").alias("seq"),
                     F.col("l_shipdate").alias("ts"),
                     F.get(F.array(*[F.lit(s) for s in STATUS_CYCLE]), idx.cast("int")).alias("status"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with outcomes: every document is a prediction whose
    confidence comes from its length; labelled documents have an outcome
    (quality 1 & toxic 0 accepted, quality 1 & toxic 1 modified, else
    rejected), the others are pending."""
    d = load(spark, sf_dir, "documents", ["doc_id", "n_chars", "source", "lang"])
    lab = load(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    x = d.join(lab, "doc_id", "left")
    outcome = F.when(F.col("quality").isNull(), F.lit(None).cast("string")) \
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted") \
        .when(F.col("quality") == 1, "modified").otherwise("rejected")
    return x.select(F.col("doc_id").alias("prediction_id"), F.col("source").alias("agent_name"),
                    F.col("lang").alias("action_type"), ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"),
                    outcome.alias("outcome_type"))


EVENT_OUTCOME = {"purchase": "accepted", "click": "accepted_modified", "error": "rejected", "view": "overridden",
                 "signup": "auto_executed"}


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant interactions: every event is one, its type gives the
    outcome; satisfaction answers ride on signup events (rating 1-5,
    would-recommend when k >= 50)."""
    ev = load(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return ev.select("event_id", F.col("ts").alias("timestamp"), "user_id",
                     F.concat(F.lit("agent_"), (F.col("user_id") % 5).cast("string")).alias("agent_name"),
                     _map(F.col("event_type"), EVENT_OUTCOME, None).alias("outcome"),
                     F.col("value").alias("time_to_decision_seconds"),
                     F.when(F.col("event_type") == "signup", (k % 5) + 1).alias("rating"),
                     F.when(F.col("event_type") == "signup", (k >= 50).cast("int")).alias("would_recommend"))
