"""Operators of a training-data pipeline and their registered queries.

Nothing outside this package imports it; `queries()` and `oracle_sql()` are
what `__spark_entry__` adds when the package is there.
"""
from __future__ import annotations


def queries() -> dict:
    from quarry.llm import entries

    return dict(entries.QUERIES)


def oracle_sql() -> dict[str, str]:
    from quarry.llm import entries

    return dict(entries.SQL)
