"""Transfers between studies and dictionary search."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import matching as MA
from quarry.operators.issues import TYPES
from quarry.plans import sqlbase as S
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query
from quarry.session import materialize_table
from quarry.sources.tables import load

_flags = "[" + ", ".join(f"CASE WHEN issue_{t} = 1 THEN '{t}' END" for t in sorted(TYPES)) + "]"
ITEMS_SQL = S.with_record(ISSUES) + f"""
, it AS (SELECT patient_key AS item, study_id AS study, primary_issue AS type, upper(priority_tier[1]) || priority_tier[2:] AS severity,
  list_filter({_flags}, lambda x: x IS NOT NULL) AS tokens, least(1.0, 0.6 + priority_score / 100.0) AS confidence FROM iss WHERE total_issues > 0)"""
_JAC = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def items(spark, sf):
    """Patients with issues as patterns: primary issue, tier, issue types."""
    i = issue_record(spark, sf).where("total_issues > 0")
    flags = F.array_compact(F.array(*[F.when(F.col(f"issue_{t}") == 1, t) for t in sorted(TYPES)]))
    return i.select(F.col("patient_key").alias("item"), F.col("study_id").alias("study"), F.col("primary_issue").alias("type"), F.initcap("priority_tier").alias("severity"),
                    flags.alias("tokens"), F.least(F.lit(1.0), 0.6 + F.col("priority_score") / 100.0).alias("confidence"))


@query("x3_similar_issue_sets", ITEMS_SQL + f"""
, s AS (SELECT DISTINCT array_to_string(tokens, ',') AS id, tokens FROM it)
SELECT p.id AS a, q.id AS b, round({_JAC.format(a='p.tokens', b='q.tokens')}, 6) AS jaccard FROM s p JOIN s q ON p.id < q.id
WHERE {_JAC.format(a='p.tokens', b='q.tokens')} >= 0.5""")
def q_x3(spark, sf):
    sets = items(spark, sf).select(F.array_join("tokens", ",").alias("id"), F.lit("").alias("part"), "tokens").distinct()
    return finalize(MA.similar_sets(sets, 0.5))


_MATCH_SQL = ITEMS_SQL + f"""
, n AS (SELECT type, severity, tokens, count(*) AS affected FROM it GROUP BY ALL),
p AS (SELECT s.item AS source, t.item AS target, s.study AS source_study, t.study AS target_study, s.type AS pattern_type, s.severity AS source_severity,
  t.severity AS target_severity, s.tokens, s.confidence AS sc, t.confidence AS tc, least(s.confidence, t.confidence) AS c,
  0.4 + 0.3 * ({_JAC.format(a='s.tokens', b='t.tokens')}) + CASE WHEN s.severity = t.severity THEN 0.2 ELSE 0.0 END AS similarity
  FROM it s JOIN it t ON s.study <> t.study AND s.type = t.type),
m AS (SELECT *, c * similarity AS confidence, row_number() OVER (PARTITION BY target_study ORDER BY c * similarity DESC, sc DESC, tc DESC, source, target) AS place FROM p WHERE similarity >= 0.7),
w AS (SELECT m.* EXCLUDE (c, sc, tc), affected FROM m JOIN n ON n.type = m.pattern_type AND n.severity = m.source_severity AND n.tokens = m.tokens WHERE place <= 5)"""


@query("w16_best_transfers", _MATCH_SQL + """
SELECT target_study, place, source_study, source, target, pattern_type, source_severity, target_severity, round(similarity, 6) AS similarity,
  CASE WHEN similarity >= 0.95 THEN 'exact' WHEN similarity >= 0.85 THEN 'similar' ELSE 'related' END AS match_type, round(confidence, 6) AS confidence, affected FROM w""")
def q_w16(spark, sf):
    return finalize(MA.transfer_matches(items(spark, sf)))


@query("v12_transfer_recommendations", _MATCH_SQL + """
, r AS (SELECT *, confidence * 0.4 + CASE source_severity WHEN 'Critical' THEN 1.0 WHEN 'High' THEN 0.75 WHEN 'Medium' THEN 0.5 WHEN 'Low' THEN 0.25 ELSE 0.5 END * 0.3
  + CASE WHEN affected >= 100 THEN 0.3 WHEN affected >= 50 THEN 0.2 WHEN affected >= 20 THEN 0.1 ELSE 0.0 END AS score,
  list_position(['Low', 'Medium', 'High', 'Critical'], source_severity) - list_position(['Low', 'Medium', 'High', 'Critical'], target_severity) AS steps FROM w WHERE confidence >= 0.6)
SELECT target_study, place, source_study, source, target, round(confidence, 6) AS confidence,
  CASE WHEN score >= 0.8 THEN 'Critical' WHEN score >= 0.6 THEN 'High' WHEN score >= 0.4 THEN 'Medium' ELSE 'Low' END AS priority, abs(steps) > 1 AS severity_calibration FROM r""")
def q_v12(spark, sf):
    r = MA.transfer_recommendations(MA.transfer_matches(items(spark, sf)))
    return finalize(r.select("target_study", "place", "source_study", "source", "target", "confidence", "priority", "severity_calibration"))


_WORDS = "regexp_extract_all(lower({c}), '[a-z]+')"
DICT_SQL = f"""
WITH w AS (SELECT DISTINCT unnest({_WORDS.format(c='text')}) AS term FROM documents),
d AS (SELECT 'C' || substr(md5(term), 1, 7) AS code, term FROM w WHERE length(term) >= 5),
v AS (SELECT term || 's' AS variation, term FROM d WHERE length(term) >= 8),
q AS (SELECT DISTINCT query, lower(trim(query)) AS q FROM (
  SELECT unnest({_WORDS.format(c='text')}) AS query FROM benchmark UNION ALL SELECT p_name FROM part UNION ALL SELECT upper(variation) FROM v WHERE length(variation) >= 12
  UNION ALL SELECT substr(code, 2, 6) FROM d WHERE length(term) >= 14) WHERE lower(trim(query)) <> ''),
f AS (
  SELECT query, code, d.term, 0 AS kind, 1.0 AS score FROM q JOIN v ON v.variation = q.q JOIN d ON d.term = v.term
  UNION ALL SELECT query, code, term, CASE WHEN term = q THEN 1 ELSE 2 END, CASE WHEN term = q THEN 1.0 ELSE length(q) / length(term) END FROM q JOIN d ON contains(term, q)
  UNION ALL SELECT query, code, term, 3, length(term) / length(q) FROM q JOIN d ON contains(q, term) AND term <> q
  UNION ALL SELECT query, code, term, 4, 0.9 FROM q JOIN d ON contains(lower(code), q)),
o AS (SELECT query, code, term, min({{'kind': kind, 'score': score}}) AS m FROM f GROUP BY ALL),
r AS (SELECT query, code, term, m.kind AS kind, m.score AS score, row_number() OVER (PARTITION BY query ORDER BY m.score DESC, m.kind, code, term) AS place FROM o)"""


@query("v15_dictionary_search", DICT_SQL + """
SELECT query, place, code, term, ['exact_variation', 'exact', 'contains', 'partial', 'code'][kind + 1] AS match_type, round(score, 6) AS score FROM r WHERE place <= 20""")
def q_v15(spark, sf):
    words = lambda df, least: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))).alias("word"))
    d = words(load(spark, sf, "documents", ["text"]), 5).distinct().select(F.concat(F.lit("C"), F.left(F.md5("word"), F.lit(7))).alias("code"), F.col("word").alias("term"))
    d = materialize_table(d, "dictionary-words")  # documents are read once
    v = d.where(F.length("term") >= 8).select(F.concat("term", F.lit("s")).alias("variation"), "term")
    q = (words(load(spark, sf, "benchmark", ["text"]), 1).select(F.col("word").alias("query")).unionAll(load(spark, sf, "part", ["p_name"]))
         .unionAll(v.where(F.length("variation") >= 12).select(F.upper("variation"))).unionAll(d.where(F.length("term") >= 14).select(F.substring("code", 2, 6))))
    return finalize(MA.search_dictionary(q, d, v))
