"""Governance decisions over proposed actions (P31-P34): the resolution
recommendations are the actions an assistant would propose."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import decisions as D
from quarry.plans.registry import finalize, query
from quarry.plans.resolution_q import RECS_SQL, recs


def actions(spark, sf):
    r = recs(spark, sf)
    return r.select("patient_key", "issue_rank", F.col("issue_type").alias("action_type"),
                    F.col("recommended_action").alias("description"),
                    F.when(F.col("issue_type").startswith("sae"), "sae").otherwise("patient").alias("entity_type"),
                    F.array(F.lower(F.regexp_replace("responsible_role", " ", "_")),
                            F.when(F.col("issue_type") == "inactivated_forms", F.lit("modify_locked")).otherwise(F.lit("routine")))
                    .alias("tags"), "confidence")


def _kw_first(text):
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN '{p}'" for k, p in config.PROHIBITION_KEYWORDS) + " END"


def _any(text, kws):
    return "(" + " OR ".join(f"contains({text}, '{k}')" for k in kws) + ")"


_PT = ("coalesce(CASE WHEN action_type IN (" + ", ".join(f"'{k}'" for k in config.PROHIBITED_ACTIONS) + ") THEN action_type END, "
       f"{_kw_first('lower(action_type)')}, {_kw_first('lower(description)')}, "
       f"list_filter(list_transform(tags, lambda t: {_kw_first('lower(t)')}), lambda x: x IS NOT NULL)[1])")
_TXT = "lower(concat_ws(' ', action_type, description))"
_KW = (f"CASE WHEN {_any(_TXT, config.RISK_CRITICAL_KEYWORDS)} THEN 3 WHEN {_any(_TXT, config.RISK_HIGH_KEYWORDS)} THEN 2 "
       f"WHEN {_any(_TXT, config.RISK_MEDIUM_KEYWORDS)} THEN 1 ELSE 0 END")
_ENT = "coalesce(CASE lower(entity_type) " + " ".join(
    f"WHEN '{k}' THEN {config.RISK_ORDER.index(v)}" for k, v in config.ENTITY_RISK.items()) + " END, 0)"
_TC = f"len(list_filter(tags, lambda t: {_any('lower(t)', config.RISK_CRITICAL_KEYWORDS)})) > 0"
_TH = f"len(list_filter(tags, lambda t: {_any('lower(t)', config.RISK_HIGH_KEYWORDS)})) > 0"
_LVL = f"CASE WHEN {_TC} THEN 3 WHEN {_TH} THEN greatest(greatest({_KW}, {_ENT}), 2) ELSE greatest({_KW}, {_ENT}) END"
_RISK = "[" + ", ".join(f"'{r}'" for r in config.RISK_ORDER) + f"][{_LVL} + 1]"
_CONF = "CASE " + " ".join(f"WHEN confidence >= {t} THEN '{lab}'" for t, lab in config.CONFIDENCE_LEVELS) + \
    f" ELSE '{config.CONFIDENCE_FLOOR}' END"
_MAT = "CASE " + " ".join(f"WHEN cl = '{cl}' AND rk = '{r}' THEN '{d}'" for cl, row in config.AUTONOMY_MATRIX.items()
                          for r, d in row.items()) + " END"
_REQ = lambda i: "CASE md " + " ".join(
    f"WHEN '{d}' THEN {repr(v[i]).lower() if isinstance(v[i], bool) else (repr(v[i]) if not isinstance(v[i], str) else repr(v[i]))}"
    for d, v in config.APPROVAL_REQUIREMENTS.items()) + " END"
_MIN = "CASE pt " + " ".join(f"WHEN '{k}' THEN '{a}'" for k, (_, a) in config.PROHIBITED_ACTIONS.items()) + " END"
_REASON = "CASE pt " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, (r, _) in config.PROHIBITED_ACTIONS.items() if r) + " END"


@query("p31_p34_governance_decisions", RECS_SQL + f""",
act AS (SELECT patient_key, issue_rank, issue_type AS action_type, recommended_action AS description,
  CASE WHEN starts_with(issue_type, 'sae') THEN 'sae' ELSE 'patient' END AS entity_type,
  [lower(replace(responsible_role, ' ', '_')), CASE WHEN issue_type = 'inactivated_forms' THEN 'modify_locked' ELSE 'routine' END] AS tags,
  CAST(confidence AS DOUBLE) AS confidence FROM recs),
d0 AS (SELECT *, {_PT} AS pt, {_RISK} AS rk, {_CONF} AS cl FROM act),
d1 AS (SELECT *, {_MAT} AS md FROM d0)
SELECT patient_key, issue_rank, action_type, cl AS confidence_level, pt IS NOT NULL AS is_prohibited, pt AS prohibited_type,
  CASE WHEN pt IS NOT NULL THEN coalesce({_REASON}, 'Matched prohibition keyword for ' || pt) END AS prohibited_reason,
  CASE WHEN pt IS NOT NULL THEN 'critical' ELSE rk END AS risk_level,
  CASE WHEN pt IS NOT NULL THEN 'block' ELSE md END AS action_decision,
  CASE WHEN pt IS NOT NULL THEN true ELSE {_REQ(0)} END AS requires_approval,
  CASE WHEN pt IS NOT NULL THEN {_MIN} ELSE {_REQ(1)} END AS approval_level,
  CAST(CASE WHEN pt IS NOT NULL THEN CASE WHEN {_MIN} IN ('sponsor', 'committee') THEN 2 ELSE 1 END ELSE {_REQ(2)} END AS BIGINT) AS approvers_required,
  CAST(CASE WHEN pt IS NOT NULL THEN 168 ELSE {_REQ(3)} END AS BIGINT) AS approval_expiry_hours
FROM d1""")
def q_p31(spark, sf):
    d = D.decide(actions(spark, sf))
    return finalize(d.select("patient_key", "issue_rank", "action_type", "confidence_level", "is_prohibited", "prohibited_type",
                             "prohibited_reason", "risk_level", "action_decision", "requires_approval", "approval_level",
                             "approvers_required", "approval_expiry_hours"))
