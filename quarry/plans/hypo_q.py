"""Hypotheses, evidence chains and JSON properties."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import hypotheses as HY
from quarry.operators import issues as IS
from quarry.operators import jsondata as JS
from quarry.plans import sqlbase as S
from quarry.plans.cache import shared_plan
from quarry.plans.gov_q import PRED_SQL
from quarry.plans.issues_q import ISSUES, issue_record
from quarry.plans.registry import finalize, query
from quarry.sources import testmap
from quarry.sources.tables import load


@shared_plan
def found(spark, sf):
    i = issue_record(spark, sf)
    return HY.hypotheses(IS.issue_rows(i, ("patient_key", "study_id", "total_issues", "priority_tier")))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_special = " ".join(f"WHEN type = '{t}' AND n > {above} THEN {{}}".format(f"[{d}, {w}]") for t, (above, d, w) in config.HYPOTHESIS_SPECIAL_EVIDENCE.items())
_own = " ".join(f"WHEN '{t}' THEN [{', '.join(map(_q, a))}]" for t, a in config.HYPOTHESIS_ADVICE.items())
_by_cause = ", ".join(f"CASE WHEN regexp_matches(cause, '{'|'.join(words)}') THEN {_q(text)} END" for words, text in config.HYPOTHESIS_CAUSE_ADVICE)
HYPO_SQL = S.with_record(ISSUES) + ", ir AS (" + " UNION ALL ".join(
    f"SELECT patient_key, study_id, '{t}' AS type, CAST(count_{t} AS DOUBLE) AS n, CAST(severity_{t} AS DOUBLE) AS sev, total_issues, priority_tier FROM iss WHERE issue_{t} = 1" for t in IS.TYPES) + f"""),
tp AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, t)) + ')' for t in config.HYPOTHESIS_TEMPLATES)}) v(type, cause, base, first_check)),
ev AS (SELECT *, list_filter([[1.0, 0.5], CASE WHEN n > 0 THEN [CASE WHEN n <= 2 THEN 0.3 WHEN n <= 5 THEN 0.6 ELSE least(n / 10, 1.0) END, 0.8] END,
    CASE WHEN sev > 0 THEN [least(sev, 1.0), 0.7] END, CASE WHEN total_issues > 1 THEN [least(total_issues / 5, 0.8), 0.4] END,
    CASE WHEN priority_tier IN ('critical', 'high') THEN [CASE WHEN priority_tier = 'critical' THEN 0.9 ELSE 0.7 END, 0.6] END, CASE {_special} END], lambda e: e IS NOT NULL) AS e FROM ir),
cf AS (SELECT *, least(list_sum(list_transform(e, lambda x: x[1] * x[2])) / list_sum(list_transform(e, lambda x: x[2])) + least(0.2, len(e) * 0.04), 1.0) AS c, 0.15 / sqrt(len(e)) AS margin FROM ev WHERE len(e) >= 2),
hr AS (SELECT patient_key, study_id, cf.type, cause, base, first_check, len(e) AS n_evidence, round_even(c, 3) AS confidence, round_even(greatest(0.0, c - margin), 3) AS low,
  round_even(least(1.0, c + margin), 3) AS high FROM cf JOIN tp ON tp.type = cf.type),
hs AS (SELECT *, list_concat(CASE WHEN confidence < 0.5 THEN ['VERIFY FIRST: ' || first_check] ELSE [] END, coalesce(CASE type {_own} END, []),
  list_filter([{_by_cause}], lambda t: t IS NOT NULL)) AS advice FROM hr),
hy AS (SELECT *, CASE WHEN type IN ('sae_dm_pending', 'sae_safety_pending') THEN CASE WHEN confidence >= 0.5 THEN 'Critical' ELSE 'High' END
    WHEN confidence < 0.3 THEN 'Low' WHEN confidence < 0.5 THEN CASE WHEN base IN ('Critical', 'High') THEN 'Medium' ELSE 'Low' END
    WHEN confidence < 0.7 AND base = 'Critical' THEN 'High' ELSE base END AS priority,
  array_to_string(list_slice(CASE WHEN len(advice) < 2 THEN list_append(advice, {_q(config.HYPOTHESIS_DEFAULT_ADVICE)}) ELSE advice END, 1, 4), ' | ') AS recommendations FROM hs)"""


@query("d31_d32_hypotheses", HYPO_SQL + """
SELECT patient_key, type AS issue_type, cause AS root_cause, n_evidence, confidence, low, high, priority, recommendations FROM hy""")
def q_d31(spark, sf):
    return finalize(found(spark, sf).select("patient_key", "issue_type", "root_cause", "n_evidence", "confidence", "low", "high", "priority",
                                            F.array_join("recommendations", " | ").alias("recommendations")))


@query("a62_hypothesis_counters", HYPO_SQL + """
SELECT type AS issue_type, cause AS root_cause, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band,
  count(*) AS hypotheses, count(DISTINCT patient_key) AS patients FROM hy GROUP BY ALL""")
def q_a62(spark, sf):
    return finalize(HY.hypothesis_counters(found(spark, sf)))


@query("d33_evidence_chains", "WITH " + PRED_SQL + """,
pc AS (SELECT agent_name, action_type, outcome_type IN ('accepted', 'auto_executed') AS supports,
  CASE WHEN confidence >= 0.75 THEN 10 WHEN confidence >= 0.5 THEN 7 WHEN confidence >= 0.25 THEN 4 ELSE 1 END AS s FROM dec),
ch AS (SELECT agent_name, action_type, count(*) AS n, coalesce(sum(s) FILTER (WHERE supports), 0) AS f, coalesce(sum(s) FILTER (WHERE NOT supports), 0) AS a FROM pc GROUP BY ALL),
cc AS (SELECT *, CASE WHEN f > 0 THEN greatest(0.0, least(1.0, ((f - a) / 10.0 / n + 1) / 2)) ELSE 0.0 END AS c FROM ch)
SELECT agent_name, action_type, n AS n_evidence, round(c, 6) AS confidence, round(CASE WHEN f > 0 THEN greatest(0.0, c - 0.15 / sqrt(n)) ELSE 0.0 END, 6) AS low,
  round(CASE WHEN f > 0 THEN least(1.0, c + 0.15 / sqrt(n)) ELSE 0.0 END, 6) AS high,
  CASE WHEN c >= 0.8 THEN 'strong' WHEN c >= 0.6 THEN 'moderate' WHEN c >= 0.4 THEN 'weak' ELSE 'inconclusive' END AS strength FROM cc""")
def q_d33(spark, sf):
    p = testmap.predictions(spark, sf).filter(F.col("outcome_type").isin("accepted", "modified", "rejected", "auto_executed"))
    c = F.col("confidence")
    strength = F.when(c >= 0.75, "strong").when(c >= 0.5, "moderate").when(c >= 0.25, "weak").otherwise("inconclusive")
    pieces = p.select("agent_name", "action_type", strength.alias("strength"), F.col("outcome_type").isin("accepted", "auto_executed").alias("supports"))
    return finalize(HY.chain_confidence(pieces, "agent_name", "action_type"))


@query("p29_event_properties", """
WITH j AS (SELECT event_id, json(props) AS p FROM events WHERE json_valid(props)),
k AS (SELECT event_id, unnest(json_keys(p)) AS key, p FROM j)
SELECT event_id, key, json_type(p, '$.' || key) AS kind, p ->> ('$.' || key) AS value FROM k WHERE json_type(p, '$.' || key) <> 'NULL'""")
def q_p29(spark, sf):
    e = load(spark, sf, "events", ["event_id", "props"])
    parsed, _ = JS.parsed(e, "props")
    kinds = {"BIGINT": "UBIGINT"}  # as the other engine names them
    out = JS.clean_metadata(parsed, "event_id", "props")
    return finalize(out.select("event_id", "key", F.coalesce(F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("kind")], F.col("kind")).alias("kind"), "value"))


@query("p29_property_schema", """
SELECT count(*) AS documents, count(*) FILTER (WHERE NOT coalesce(json_valid(props), false)) AS invalid FROM events""")
def q_p29_schema(spark, sf):
    good, bad = JS.parsed(load(spark, sf, "events", ["event_id", "props"]), "props")
    return finalize(JS.describe(good, bad, "props").select("documents", "invalid"))
