"""Semi-structured properties: JSON text to VARIANT, typed values and back.

A VARIANT keeps each document's own types in a binary form that paths are read
from without parsing the text again; text that is no JSON is kept aside.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is JSON, with it as VARIANT; the other rows as they
    are, a null text among them)."""
    x = df.withColumn("_variant", F.try_parse_json(F.col(column)))
    good = x.where(F.col("_variant").isNotNull()).withColumn(column, F.col("_variant")).drop("_variant")
    return good, x.where(F.col("_variant").isNull()).drop("_variant")


def clean_metadata(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name, kind, value) of every property of each document that is
    an object: text, numbers and truth values as text of their own, lists and
    objects as JSON text; nulls are left out."""
    x = df.select(F.col(key), F.explode(F.try_variant_get(F.col(column), "$", "map<string, variant>")).alias("name", "v"))
    kind = F.schema_of_variant("v")
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    value = F.when(nested, F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
    short = F.when(kind.startswith("ARRAY"), "ARRAY").when(kind.startswith("OBJECT"), "OBJECT").otherwise(kind)
    return x.where(~F.is_variant_null("v") & (kind != "VOID")).select(key, F.col("name").alias("key"), short.alias("kind"), value.alias("value"))


def packed(properties: DataFrame, key: str) -> DataFrame:
    """The way back: one JSON text for each key from its cleaned properties."""
    typed = F.when(F.col("kind").isin("STRING"), F.to_json(F.struct(F.col("value").alias("v")))).otherwise(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")))
    body = F.substring(typed, F.lit(6), F.length(typed) - 6)  # what stands for the value
    name = F.to_json(F.struct(F.col("key").alias("v")))
    pair = F.concat(F.substring(name, F.lit(6), F.length(name) - 6), F.lit(":"), body)
    return properties.groupBy(key).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(pair)), ","), F.lit("}")).alias("json"))


def describe(good: DataFrame, bad: DataFrame, column: str) -> DataFrame:
    """One row: documents, those that are no JSON, and the schema that holds all."""
    return (good.agg(F.count("*").alias("_g"), F.schema_of_variant_agg(F.col(column)).alias("schema")).crossJoin(bad.agg(F.count("*").alias("invalid")))
            .select((F.col("_g") + F.col("invalid")).alias("documents"), "invalid", "schema"))
