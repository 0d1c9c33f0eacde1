"""Ingestion, cleaning, detail aggregates, adaptive joins, validation
(S5-S8, S15, S17, P1-P18, A1-A7, J2, J3, P17)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import cleaning as CL
from quarry.operators import detail, record
from quarry.plans import sqlbase as S
from quarry.plans.core import rec
from quarry.plans.registry import finalize, query
from quarry.sources import ingest, testmap
from quarry.sources.tables import load

_CS_COLS = ["patient_key", "study_id", "site_id", "subject_id", "region", "country", "subject_status_clean",
            "acct_balance", "latest_visit"]


@query("p6_p18_clean_subjects", "WITH " + S.RAW_CPID + "," + S.CLEAN_SUBJECTS +
       f"\nSELECT {', '.join(S.r6(c, c) if c == 'acct_balance' else c for c in _CS_COLS)} FROM clean_subjects")
def q_clean_subjects(spark, sf):
    return finalize(CL.clean_subjects(testmap.raw_cpid(spark, sf)).select(*_CS_COLS))


_MESSY = [("c_custkey", "Subject ID"), ("c_name", " Subject  Name\n"), ("c_nationkey", "Site#"),
          ("c_acctbal", "Acct. Balance ($)"), ("c_mktsegment", ""), ("c_custkey", "Subject ID ")]


@query("p1_normalize_headers", "SELECT c_custkey AS subject_id, c_name AS subject_name, c_nationkey AS site, "
       "round(c_acctbal, 6) AS acct_balance, c_mktsegment AS unnamed, c_custkey AS subject_id_1 FROM customer")
def q_headers(spark, sf):
    c = load(spark, sf, "customer")
    raw = c.select(*[F.col(src).alias(dst) for src, dst in _MESSY])
    return finalize(CL.normalize_headers(raw))


_CAT = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
        ("c_mktsegment", "string")]


@query("s15_column_catalogue", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST({i} AS BIGINT) AS ordinal, count({c}) AS non_null_count, "
    f"round(CASE WHEN count(*) > 0 THEN (count(*) - count({c})) * 100.0 / count(*) ELSE 0.0 END, 6) AS null_pct "
    f"FROM customer" for i, (c, t) in enumerate(_CAT)))
def q_catalogue(spark, sf):
    return finalize(record.column_catalogue(load(spark, sf, "customer")))


def _sae_extracts(spark, sf):
    """One order extract split into a DM and a Safety tab with different
    column sets; S6/S7/S8 on top."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]) \
        .filter(F.expr(testmap.ORDER_PRED["sae"]))
    o = ingest.add_lineage(o, "sae_dashboard", F.concat(F.lit("Study_"), (F.col("o_custkey") % 5).cast("string")),
                           ingestion_ts="2024-01-01 00:00:00")
    review = F.when(F.col("o_orderstatus") == "P", config.SAE_REVIEW_STATUS["P"]) \
        .when(F.col("o_orderstatus") == "F", config.SAE_REVIEW_STATUS["F"]).otherwise(config.SAE_REVIEW_STATUS["O"])
    lineage = ["_source_file", "_study_id", "_ingestion_ts", "_file_type"]
    dm = o.filter(F.col("o_orderkey") % 2 == 0).select(
        F.col("o_custkey").alias("patient_id"), review.alias("review_status"), *lineage,
        F.lit("DM").alias("_sae_type"))
    safety = o.filter(F.col("o_orderkey") % 2 == 1).select(
        F.col("o_custkey").alias("patient_id"), review.alias("review_status"),
        F.col("o_orderpriority").alias("seriousness"), *lineage, F.lit("Safety").alias("_sae_type"))
    return ingest.drop_all_null(ingest.union_by_name([dm, safety]))


@query("s17_run_manifest", f"""
SELECT 'sae_dashboard' AS _file_type, 'Study_' || CAST(o_custkey % 5 AS VARCHAR) AS _study_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'DM' ELSE 'Safety' END AS _sae_type, 'orders.parquet' AS _source_file,
  count(*) AS records, count(*) > {config.LARGE_STUDY_THRESHOLD} AS is_large,
  count(seriousness) AS with_seriousness
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS seriousness FROM orders
      WHERE {testmap.ORDER_PRED['sae']})
GROUP BY ALL""")
def q_manifest(spark, sf):
    u = _sae_extracts(spark, sf)
    m = u.groupBy("_file_type", "_study_id", "_sae_type", "_source_file").agg(
        F.count(F.lit(1)).alias("records"), F.count("seriousness").alias("with_seriousness"))
    return finalize(m.withColumn("is_large", F.col("records") > config.LARGE_STUDY_THRESHOLD))


# ------------------------------------------------------------ standalone A1-A7
def _keyed(df):
    study, site, subj = CL.std_study(F.col("study")), CL.std_site(F.col("site")), CL.std_subject(F.col("subject"))
    return df.select("*", CL.patient_key(study, site, subj).alias("patient_key"), study.alias("study_id"),
                     site.alias("site_id"), subj.alias("subject_id")).filter(F.col("subject_id").isNotNull())


def _ids():
    return [F.min("study_id").alias("study_id"), F.min("site_id").alias("site_id"),
            F.min("subject_id").alias("subject_id")]


_ORD_KEYED = f"""
ok AS (
  SELECT {S.pkey(S.std_study('study'), S.std_site('site'), S.std_subject('subject'))} AS patient_key,
    {S.std_study('study')} AS study_id, {S.std_site('site')} AS site_id, {S.std_subject('subject')} AS subject_id, *
  FROM (SELECT 'Study ' || CAST(n.n_regionkey AS VARCHAR) AS study, {S.site_text('c.c_custkey', 'c.c_nationkey')} AS site,
          {S.subject_text('c.c_custkey')} AS subject, o.*
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        WHERE {{where}})
)"""


@query("a1_missing_visits", "WITH " + _ORD_KEYED.format(where=testmap.ORDER_PRED["visit"]) + f"""
SELECT patient_key, min(study_id) AS study_id, min(site_id) AS site_id, min(subject_id) AS subject_id,
  count(*) AS visit_missing_visit_count,
  round(max(CAST(date_diff('day', CAST(o_orderdate AS DATE), {S.AS_OF_STAR}) AS DOUBLE)), 6) AS visit_visits_overdue_max_days,
  round(avg(CAST(date_diff('day', CAST(o_orderdate AS DATE), {S.AS_OF_STAR}) AS DOUBLE)), 6) AS visit_visits_overdue_avg_days
FROM ok WHERE subject_id IS NOT NULL GROUP BY patient_key""")
def q_a1(spark, sf):
    rows = _keyed(testmap.raw_order_rows(spark, sf, testmap.ORDER_PRED["visit"]))
    days = F.datediff(F.lit(config.AS_OF_STAR), F.to_date("o_orderdate"))
    return finalize(detail.aggregate_detail(rows, "patient_key", _ids() + detail.visit_aggs(days)))


@query("a3_sae_dashboard", "WITH " + _ORD_KEYED.format(where=testmap.ORDER_PRED["sae"]) + """
SELECT patient_key, min(study_id) AS study_id, min(site_id) AS site_id, min(subject_id) AS subject_id,
  count(*) FILTER (WHERE o_orderkey % 2 = 0) AS sae_dm_sae_dm_total,
  count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'P') AS sae_dm_sae_dm_pending,
  count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'F') AS sae_dm_sae_dm_completed,
  count(*) FILTER (WHERE o_orderkey % 2 = 1) AS sae_safety_sae_safety_total,
  count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'P') AS sae_safety_sae_safety_pending,
  count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'F') AS sae_safety_sae_safety_completed
FROM ok WHERE subject_id IS NOT NULL GROUP BY patient_key""")
def q_a3(spark, sf):
    rows = _keyed(testmap.raw_order_rows(spark, sf, testmap.ORDER_PRED["sae"]))
    review = F.when(F.col("o_orderstatus") == "P", config.SAE_REVIEW_STATUS["P"]) \
        .when(F.col("o_orderstatus") == "F", config.SAE_REVIEW_STATUS["F"]).otherwise(config.SAE_REVIEW_STATUS["O"])
    even = F.col("o_orderkey") % 2 == 0
    return finalize(detail.aggregate_detail(rows, "patient_key", _ids() + detail.sae_aggs(review, "dm", even)
                                            + detail.sae_aggs(review, "safety", ~even)))


@query("a4_inactivated_forms", "WITH " + _ORD_KEYED.format(where=testmap.ORDER_PRED["inactivated"]) + """
SELECT patient_key, min(study_id) AS study_id, min(site_id) AS site_id, min(subject_id) AS subject_id,
  count(*) AS inactivated_inactivated_form_count, count(DISTINCT o_orderkey % 7) AS inactivated_inactivated_unique_forms
FROM ok WHERE subject_id IS NOT NULL GROUP BY patient_key""")
def q_a4(spark, sf):
    rows = _keyed(testmap.raw_order_rows(spark, sf, testmap.ORDER_PRED["inactivated"]))
    form = F.concat(F.lit("Form_"), (F.col("o_orderkey") % 7).cast("string"))
    return finalize(detail.aggregate_detail(rows, "patient_key", _ids() + detail.inactivated_aggs(form)))


def _line_rows(spark, sf, where):
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                      "l_returnflag", "l_linestatus", "l_shipdate"]).filter(F.expr(where))
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    c = load(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    n = load(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey) \
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    ck = F.col("c_custkey")
    return _keyed(x.select(F.concat(F.lit("Study "), F.col("n_regionkey").cast("string")).alias("study"),
                           testmap.raw_site_text(ck, F.col("c_nationkey")).alias("site"),
                           testmap.raw_subject_text(ck).alias("subject"), *li.columns))


_LINE_KEYED = f"""
lk AS (
  SELECT {S.pkey(S.std_study('study'), S.std_site('site'), S.std_subject('subject'))} AS patient_key,
    {S.std_study('study')} AS study_id, {S.std_site('site')} AS site_id, {S.std_subject('subject')} AS subject_id, *
  FROM (SELECT 'Study ' || CAST(n.n_regionkey AS VARCHAR) AS study, {S.site_text('c.c_custkey', 'c.c_nationkey')} AS site,
          {S.subject_text('c.c_custkey')} AS subject, l.*
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE {{where}})
)"""


@query("a5_missing_pages", "WITH " + _LINE_KEYED.format(where=testmap.LINE_PRED["pages"]) + f"""
SELECT patient_key, min(study_id) AS study_id, min(site_id) AS site_id, min(subject_id) AS subject_id,
  count(*) AS pages_missing_page_count,
  round(max(CAST(date_diff('day', CAST(l_shipdate AS DATE), {S.AS_OF_STAR}) AS DOUBLE)), 6) AS pages_pages_missing_max_days,
  round(avg(CAST(date_diff('day', CAST(l_shipdate AS DATE), {S.AS_OF_STAR}) AS DOUBLE)), 6) AS pages_pages_missing_avg_days
FROM lk WHERE subject_id IS NOT NULL GROUP BY patient_key""")
def q_a5(spark, sf):
    rows = _line_rows(spark, sf, testmap.LINE_PRED["pages"])
    days = F.datediff(F.lit(config.AS_OF_STAR), F.to_date("l_shipdate"))
    return finalize(detail.aggregate_detail(rows, "patient_key", _ids() + detail.pages_aggs(days)))


@query("a7_coding_totals", "WITH " + _LINE_KEYED.format(where=testmap.LINE_PRED["coding"]) + """
SELECT patient_key, min(study_id) AS study_id, min(subject_id) AS subject_id,
  count(*) FILTER (WHERE l_linenumber % 2 = 1) AS meddra_coding_meddra_total,
  count(*) FILTER (WHERE l_linenumber % 2 = 1 AND l_returnflag <> 'N') AS meddra_coding_meddra_coded,
  count(*) FILTER (WHERE l_linenumber % 2 = 1 AND l_returnflag = 'N') AS meddra_coding_meddra_uncoded,
  count(*) FILTER (WHERE l_linenumber % 2 = 0) AS whodrug_coding_whodrug_total,
  count(*) FILTER (WHERE l_linenumber % 2 = 0 AND l_returnflag <> 'N') AS whodrug_coding_whodrug_coded,
  count(*) FILTER (WHERE l_linenumber % 2 = 0 AND l_returnflag = 'N') AS whodrug_coding_whodrug_uncoded
FROM lk WHERE subject_id IS NOT NULL GROUP BY patient_key""")
def q_a7(spark, sf):
    rows = _line_rows(spark, sf, testmap.LINE_PRED["coding"])
    status = F.when(F.col("l_returnflag") == "N", "UnCoded Term").otherwise("Coded Term")
    odd = F.col("l_linenumber") % 2 == 1
    aggs = [F.min("study_id").alias("study_id"), F.min("subject_id").alias("subject_id")] + \
        detail.coding_aggs(status, "meddra", odd) + detail.coding_aggs(status, "whodrug", ~odd)
    return finalize(detail.aggregate_detail(rows, "patient_key", aggs))


@query("a2_lab_issues", f"""
SELECT 'Subject_' || CAST(user_id AS VARCHAR) AS subject_id, count(*) AS lab_lab_issue_count
FROM events WHERE {testmap.EVENT_PRED['lab']} GROUP BY user_id""")
def q_a2(spark, sf):
    ev = load(spark, sf, "events", ["user_id", "event_type", "value"]).filter(F.expr(testmap.EVENT_PRED["lab"]))
    rows = ev.select(CL.std_subject(F.col("user_id").cast("string")).alias("subject_id"))
    return finalize(detail.aggregate_detail(rows, "subject_id", detail.lab_aggs()))


def _edrr_agg(spark, sf):
    """A6 over raw EDRR rows: study + subject, site Unknown."""
    rows = testmap.edrr_rows(spark, sf)
    study, subj = CL.std_study(F.col("study")), CL.std_subject(F.col("subject"))
    keyed = rows.select(CL.patient_key(study, F.lit("Unknown"), subj).alias("patient_key"),
                        study.alias("study_id"), subj.alias("subject_id"),
                        "total_open_issue_count_per_subject").filter(F.col("subject_id").isNotNull())
    agg = keyed.groupBy("patient_key").agg(F.min("study_id").alias("study_id"),
                                           F.min("subject_id").alias("subject_id"),
                                           *detail.edrr_aggs(F.col("total_open_issue_count_per_subject")))
    return agg.withColumn("site_id", F.lit("Unknown"))


_EDRR_SQL = f"""
edrr AS (
  SELECT 'Study_' || CAST(n.n_regionkey AS VARCHAR) || '|Unknown|Subject_' || CAST(e.user_id AS VARCHAR) AS patient_key,
    'Study_' || CAST(n.n_regionkey AS VARCHAR) AS study_id, 'Subject_' || CAST(e.user_id AS VARCHAR) AS subject_id,
    count(*) AS edrr_edrr_issue_count, 'Unknown' AS site_id
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE {testmap.EVENT_PRED['edrr']}
  GROUP BY ALL
)"""


@query("a6_edrr_issues", "WITH " + _EDRR_SQL + " SELECT * FROM edrr")
def q_a6(spark, sf):
    return finalize(_edrr_agg(spark, sf))


@query("j2_adaptive_key_join", S.with_record(_EDRR_SQL) + """
SELECT r.patient_key, r.study_id, r.site_id, r.subject_id, e.edrr_edrr_issue_count, 'fallback_key' AS join_strategy
FROM record r LEFT JOIN edrr e ON r.study_id = e.study_id AND r.subject_id = e.subject_id""")
def q_j2(spark, sf):
    left = rec(spark, sf).select("patient_key", "study_id", "site_id", "subject_id")
    out, strategy = record.adaptive_key_join(left, _edrr_agg(spark, sf), ["patient_key"], ["study_id", "subject_id"])
    return finalize(out.select("patient_key", "study_id", "site_id", "subject_id", "edrr_edrr_issue_count")
                    .withColumn("join_strategy", F.lit(strategy)))


@query("j3_key_match_rate", S.with_record(_EDRR_SQL) + """
SELECT count(*) AS detail_rows,
  count(*) FILTER (WHERE patient_key IN (SELECT patient_key FROM record)) AS full_key_matches,
  count(*) FILTER (WHERE (study_id, subject_id) IN (SELECT (study_id, subject_id) FROM record)) AS fallback_matches,
  round(count(*) FILTER (WHERE patient_key IN (SELECT patient_key FROM record)) / count(*), 6) AS full_key_rate
FROM edrr""")
def q_j3(spark, sf):
    e = _edrr_agg(spark, sf)
    left = rec(spark, sf).select("patient_key", "study_id", "subject_id")
    full = e.join(left.select("patient_key"), "patient_key", "left_semi").agg(F.count(F.lit(1)).alias("full_key_matches"))
    fb = e.join(left.select("study_id", "subject_id"), ["study_id", "subject_id"], "left_semi") \
        .agg(F.count(F.lit(1)).alias("fallback_matches"))
    n = e.agg(F.count(F.lit(1)).alias("detail_rows"))
    out = n.crossJoin(full).crossJoin(fb)
    return finalize(out.withColumn("full_key_rate", F.col("full_key_matches") / F.col("detail_rows")))


@query("p17_validate_record", S.with_record() + """
SELECT count(*) AS rows, count(DISTINCT patient_key) AS distinct_keys,
  (SELECT count(*) FROM (SELECT patient_key FROM record GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys,
  (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM record GROUP BY patient_key HAVING count(*) > 1))
    AS duplicate_rows,
  '' AS missing_required
FROM record""")
def q_p17(spark, sf):
    v = record.validate_record(rec(spark, sf))
    return finalize(v.withColumn("duplicate_rows", F.col("duplicate_rows").cast("long")))
