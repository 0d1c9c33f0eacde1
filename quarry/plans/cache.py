"""Reuse of built (lazy) DataFrame plans within one session.

A DataFrame is an immutable logical plan, so the record and score plans can
be built once per (session, data folder) and shared by every query; each
query still gets its own optimised physical plan (Catalyst prunes the
columns it does not read).  No data is cached here.
"""
from __future__ import annotations

import functools

_PLANS: dict = {}


def shared_plan(fn):
    @functools.wraps(fn)
    def wrapper(spark, sf_dir, *args):
        key = (fn.__module__, fn.__qualname__, id(spark), spark.sparkContext.applicationId, sf_dir, args)
        hit = _PLANS.get(key)
        if hit is None:
            hit = fn(spark, sf_dir, *args)
            _PLANS[key] = hit
        return hit
    return wrapper


def clear() -> None:
    _PLANS.clear()


def materialized_plan(fn):
    """`shared_plan` whose result is written once per session as parquet in
    the shared checkpoint folder (see `quarry.session.materialize_table`)."""
    from quarry.session import materialize_table

    @functools.wraps(fn)
    def build(spark, sf_dir, *args):
        return materialize_table(fn(spark, sf_dir, *args), fn.__name__)

    return shared_plan(build)
