"""Registered queries (Spark) and their SQL twins (DuckDB oracle)."""
from quarry.plans.registry import ORACLE, REGISTRY, finalize, query  # noqa: F401


def load_all() -> None:
    """Import every plan module so its queries register."""
    from quarry.plans import (core, detail_q, scores_q, segment_q, issues_q, bench_q, cascade_q,  # noqa: F401
                              collab_q, gov_q, text_q, ml_q, views_q, stream_q, resolution_q, rules_q, trust_q, patterns_q, extra_q, filters_q, decisions_q, ops_q, impact_q, reports_q, more_q, stats_q, eval_q, match_q, boost_q, hypo_q, context_q, sites_q)
