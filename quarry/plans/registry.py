"""Query registry shared by `__spark_entry__`, bench and tests."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import tune_for_wide_plans

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` (and its DuckDB twin)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune_for_wide_plans(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = run
        if sql is not None:
            ORACLE[name] = decimal_round_even(sql)
        return fn
    return deco


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output normal form for comparison: integers as bigint, floats as
    double rounded to `digits` (the oracle rounds the same columns)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.round(c.cast("double"), digits).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def decimal_round_even(sql: str) -> str:
    """Rewrite every `round_even(x, d)` into half-even rounding of the
    decimal value of x (the twin of `quarry.functions.exprs.round_half_even`)."""
    out, i, key = [], 0, "round_even("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth, comma = j + len(key), 1, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = sql[j + len(key):comma], sql[comma + 1:k - 1]
        if inner.lstrip().startswith("least(CAST(") and "DECIMAL(24,6)" in inner:
            out.append(sql[j:k])  # already exact decimal
        else:
            out.append(f"CAST(round_even(CAST({decimal_round_even(inner)} AS DECIMAL(38,12)), {digits.strip()}) AS DOUBLE)")
        i = k
