"""Ingestion (S1-S8, S17): discovery, routing, lineage, union, manifest.

Discovery lists files through the `binaryFile` source without selecting
`content`, so only metadata is read; routing and study extraction are
column expressions over the path, evaluated on the executors.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config


def discover_files(spark: SparkSession, root: str, glob: str = "*.xls*") -> DataFrame:
    """Recursive listing with a glob filter; one row per file."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(root))
    return df.select("path", "length", "modificationTime",
                     F.regexp_extract(F.col("path"), r"([^/]+)$", 1).alias("file_name"))


def route_file_type(name: Column, routing=tuple(config.FILE_TYPE_ROUTING)) -> Column:
    """First type (priority order) with a case-insensitive pattern hit
    and no exclusion hit."""
    low = F.lower(name)
    expr = None
    for ftype, patterns, exclusions in routing:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | low.contains(p.lower())
        for e in exclusions:
            hit = hit & ~low.contains(e.lower())
        expr = F.when(hit, ftype) if expr is None else expr.when(hit, ftype)
    return expr.otherwise(F.lit(None).cast("string"))


def study_from_path(path: Column) -> Column:
    """S3: `study\\s*(\\d+)` (case-insensitive) -> Study_n, else null."""
    d = F.regexp_extract(F.lower(path), r"study\s*(\d+)", 1)
    return F.when(d != "", F.concat(F.lit("Study_"), d))


def drop_all_null(df: DataFrame) -> DataFrame:
    """S6"""
    return df.dropna(how="all")


def add_lineage(df: DataFrame, file_type: str, study: Column | None = None, ingestion_ts=None) -> DataFrame:
    """_source_file (base name of the scanned file), _study_id,
    _ingestion_ts (a parameter, so reruns are reproducible), _file_type."""
    src = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    ts = F.lit(ingestion_ts).cast("timestamp") if ingestion_ts is not None else F.current_timestamp()
    return df.select("*", src.alias("_source_file"),
                     (study if study is not None else F.lit(None).cast("string")).alias("_study_id"),
                     ts.alias("_ingestion_ts"), F.lit(file_type).alias("_file_type"))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Concat with null fill for missing columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_manifest(df: DataFrame, keys: Sequence[str] = ("_file_type", "_study_id"),
                 threshold: int = config.LARGE_STUDY_THRESHOLD) -> DataFrame:
    """Records by type and study, large-study flag."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records")) \
        .withColumn("is_large", F.col("records") > threshold)


_SAFE = re.compile(r"[^A-Za-z0-9_]")
