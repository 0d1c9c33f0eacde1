"""Scans and sinks.

Scans always go through `spark.read` so Catalyst can prune columns and push
filters into the parquet reader; callers select only what they use.
"""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.exprs import ntz_lit

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """S9 parquet scan; `columns` keeps the ReadSchema narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, sf_dir: str, names: Sequence[str] = TABLES) -> None:
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """CSV scan.  With no schema every column is read as string (the
    cleaning layer casts), never `inferSchema` (a second full pass)."""
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, schema=None, multiline: bool = False) -> DataFrame:
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
                  mode: str = "overwrite") -> None:
    """S12/S14 sink; `partition_by` gives one folder per segment value."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_sample_csv(df: DataFrame, path: str, n: int = 1000) -> None:
    """A bounded sample for inspection (the limit is the feature)."""
    df.limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_range(df: DataFrame, ts_col: str, start, end, path: str, fmt: str = "json") -> None:
    """Export rows with start <= ts < end."""
    out = df.filter((F.col(ts_col) >= ntz_lit(start)) & (F.col(ts_col) < ntz_lit(end)))
    getattr(out.write.mode("overwrite"), fmt)(path)
