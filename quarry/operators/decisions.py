"""Governance decision per proposed action.

Every rule table is a literal map / ordered keyword list compiled into one
projection, so a decision is a row-wise expression: no join, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config


def _first_keyword(text: Column) -> Column:
    expr = None
    for kw, ptype in config.PROHIBITION_KEYWORDS:
        cond = text.contains(kw)
        expr = F.when(cond, ptype) if expr is None else expr.when(cond, ptype)
    return expr.otherwise(F.lit(None).cast("string"))


def prohibited_type(action_type: Column, description: Column, tags: Column) -> Column:
    """Exact action type, else first keyword (declared order) in the
    type, then in the description, then in the first matching tag."""
    direct = F.when(action_type.isin(list(config.PROHIBITED_ACTIONS)), action_type)
    in_tags = F.get(F.filter(F.transform(tags, lambda t: _first_keyword(F.lower(t))), lambda x: x.isNotNull()), 0)
    return F.coalesce(direct, _first_keyword(F.lower(action_type)), _first_keyword(F.lower(description)), in_tags)


def _any_kw(text: Column, kws) -> Column:
    out = F.lit(False)
    for k in kws:
        out = out | text.contains(k)
    return out


def risk_level(action_type: Column, description: Column, entity: Column, tags: Column) -> Column:
    """Keyword level of type + description (critical, then high, then
    medium), raised by the entity's risk, then by tags (critical / high)."""
    text = F.lower(F.concat_ws(" ", action_type, description))
    kw = F.when(_any_kw(text, config.RISK_CRITICAL_KEYWORDS), 3).when(_any_kw(text, config.RISK_HIGH_KEYWORDS), 2) \
        .when(_any_kw(text, config.RISK_MEDIUM_KEYWORDS), 1).otherwise(0)
    ent = F.create_map(*[x for k, v in config.ENTITY_RISK.items() for x in (F.lit(k), F.lit(config.RISK_ORDER.index(v)))])
    lvl = F.greatest(kw, F.coalesce(ent[F.lower(entity)], F.lit(0)))
    tcrit = F.exists(tags, lambda t: _any_kw(F.lower(t), config.RISK_CRITICAL_KEYWORDS))
    thigh = F.exists(tags, lambda t: _any_kw(F.lower(t), config.RISK_HIGH_KEYWORDS))
    lvl = F.when(tcrit, 3).when(thigh, F.greatest(lvl, F.lit(2))).otherwise(lvl)
    return F.get(F.array(*[F.lit(r) for r in config.RISK_ORDER]), lvl)


def confidence_level(conf: Column) -> Column:
    expr = None
    for thr, lab in config.CONFIDENCE_LEVELS:
        expr = F.when(conf >= thr, lab) if expr is None else expr.when(conf >= thr, lab)
    return expr.otherwise(config.CONFIDENCE_FLOOR)


def decide(actions: DataFrame) -> DataFrame:
    """P33 + P34: prohibited actions are blocked (critical, minimum approval,
    two approvers for sponsor / committee, 168 h); others go through the
    confidence x risk matrix and its approval requirements."""
    c = F.col
    matrix = F.create_map(*[x for cl, row in config.AUTONOMY_MATRIX.items() for r, d in row.items()
                            for x in (F.lit(f"{cl}|{r}"), F.lit(d))])
    req = F.create_map(*[x for d, (ra, lvl, n, h) in config.APPROVAL_REQUIREMENTS.items() for x in (
        F.lit(d), F.struct(F.lit(ra).alias("ra"), F.lit(lvl).alias("lvl"), F.lit(n).alias("n"), F.lit(h).alias("h")))])
    minimum = F.create_map(*[x for k, (_, a) in config.PROHIBITED_ACTIONS.items() for x in (F.lit(k), F.lit(a))])
    reason = F.create_map(*[x for k, (r, _) in config.PROHIBITED_ACTIONS.items() for x in (F.lit(k), F.lit(r))])
    x = actions.select("*", prohibited_type(c("action_type"), c("description"), c("tags")).alias("prohibited_type"),
                       risk_level(c("action_type"), c("description"), c("entity_type"), c("tags")).alias("_risk"),
                       confidence_level(c("confidence")).alias("confidence_level"))
    prohibited = c("prohibited_type").isNotNull()
    mdec = matrix[F.concat_ws("|", c("confidence_level"), c("_risk"))]
    r = req[mdec]
    minap = minimum[c("prohibited_type")]
    return x.select(
        *actions.columns, "confidence_level", prohibited.alias("is_prohibited"), "prohibited_type",
        F.when(prohibited, F.coalesce(reason[c("prohibited_type")],
                                      F.concat(F.lit("Matched prohibition keyword for "), c("prohibited_type"))))
        .alias("prohibited_reason"),
        F.when(prohibited, "critical").otherwise(c("_risk")).alias("risk_level"),
        F.when(prohibited, "block").otherwise(mdec).alias("action_decision"),
        F.when(prohibited, True).otherwise(r["ra"]).alias("requires_approval"),
        F.when(prohibited, minap).otherwise(r["lvl"]).alias("approval_level"),
        F.when(prohibited, F.when(minap.isin("sponsor", "committee"), 2).otherwise(1)).otherwise(r["n"]).alias("approvers_required"),
        F.when(prohibited, 168).otherwise(r["h"]).alias("approval_expiry_hours"))
