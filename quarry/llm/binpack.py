"""Shards by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group.  A group that holds more than a small share of the
bytes, tokens or rows is cut into pieces (there can only be a bounded number
of such groups), the others stay whole.  Each item, largest first, goes to the
bin where the dot product of its vector with the bin's residual capacity is
highest.

Large items, of which there can only be a bounded number, are placed first in
one task.  The others are dealt by hash into parts of about `PART_ITEMS`, and
each part fills what the large ones left of every shard, in proportion to its
own share, so that parts need not know of each other and no task sees all
groups.  A part is off by no more than its smallest items.

The law is `bytes`: shard sizes come out near equal.

Defined results: a null text counts as empty (size 1); equal texts share a
shard unless their group was cut; repeated rows repeat and get slots of their
own; null doc_ids are placed like others; an empty table gives an empty one;
other columns are left behind.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.operators.ml import ordered_row_number

SHARDS = 16
PART_ITEMS = 8192
#: An item over this share of a shard, in any dimension, is large.
LARGE_SHARE = 1 / 64
#: A group over this share of a shard, in any dimension, is cut.
PIECE_SHARE = 1 / 4
SLOT_ROWS = 20_000
SIZES = ("bytes", "tokens", "n_rows")
#: What a dimension counts in the dot product: the law's dimension decides, the others settle what it leaves open.
WEIGHTS = np.array([1000.0, 1.0, 1.0])


def place(vectors: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item, most bytes first, by the highest (weighted) dot
    product of the item with the residual capacity.  Items and capacities
    (bins x dimensions) are shares of the same totals; ties go to the lower
    bin."""
    left = capacity.copy()
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-vectors[:, 0], kind="stable"):
        best = int(np.argmax(left @ (WEIGHTS * vectors[i])))
        out[i] = best
        left[best] -= vectors[i]
    return out


def shards_of(items: DataFrame, shards: int = SHARDS, part_items: int = PART_ITEMS) -> DataFrame:
    """(item, shard) for items (item, bytes, tokens, n_rows)."""
    total = items.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SIZES]).first()
    whole = np.array([max(1, total[c] or 0) for c in SIZES], float)
    limit = [w / shards * LARGE_SHARE for w in whole]
    is_large = F.greatest(*[F.col(c) / w for c, w in zip(SIZES, limit)]) > 1
    # at most 3 * shards / LARGE_SHARE of them
    large = sorted(items.where(is_large).select("item", *SIZES).collect())
    vectors = np.array([r[1:] for r in large], float).reshape(-1, len(SIZES)) / whole
    capacity = np.full((shards, len(SIZES)), 1 / shards)
    chosen = place(vectors, capacity)
    np.subtract.at(capacity, chosen, vectors)
    first = items.sparkSession.createDataFrame([(r["item"], int(c)) for r, c in zip(large, chosen)], "item bigint, shard int")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item", kind="stable")
        own = part[list(SIZES)].to_numpy(float)
        sums = own.sum(axis=0)
        free = capacity / np.maximum(capacity.sum(axis=0), 1e-12)
        return pd.DataFrame({"item": part["item"], "shard": place(own / np.where(sums > 0, sums, 1), free)})

    parts = total["n"] // part_items + 1
    rest = items.where(~is_large).withColumn("part", F.pmod(F.xxhash64(F.col("item"), F.lit(parts)), F.lit(parts)))
    return rest.groupBy("part").applyInPandas(run, "item bigint, shard int").unionByName(first)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document's size, checksum, shard and slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select(
        "doc_id", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n_words"), F.xxhash64("text").alias("key"),
        F.monotonically_increasing_id().alias("row"))  # tells equal rows apart once written
    rows = written(rows, "sizes")
    group = ["key", "text_crc32", "size"]
    groups = written(rows.groupBy(*group).agg(F.count("*").alias("n"), F.max("n_words").alias("n_words")), "groups")
    total = groups.agg(F.sum(F.col("n") * F.col("size")).alias("b"), F.sum(F.col("n") * F.col("n_words")).alias("t"), F.sum("n").alias("r")).first()
    n_rows = total["r"] or 0
    most = [max(1.0, (x or 0) / shards * PIECE_SHARE) for x in (total["b"], total["t"], n_rows)]
    pieces = F.ceil(F.greatest(F.col("n") * F.col("size") / most[0], F.col("n") * F.col("n_words") / most[1], F.col("n") / most[2]))
    # at most 3 * shards / PIECE_SHARE groups are over the limit in one of three dimensions
    large = groups.where("n > 1").withColumn("pieces", pieces).where("pieces > 1").select(*group, F.least("pieces", "n").alias("pieces"))
    mine = rows.join(F.broadcast(large), group, "left")
    # rows of a cut group are numbered, so that its pieces are equal however often a doc_id is repeated
    numbered = ordered_row_number(mine.where("pieces IS NOT NULL"), group, ["doc_id", "row"], "nth").withColumn("piece", F.pmod("nth", "pieces"))
    whole = mine.where("pieces IS NULL").withColumn("nth", F.lit(0).cast("bigint")).withColumn("piece", F.lit(0).cast("bigint"))
    cut = whole.unionByName(numbered).drop("pieces", "row")
    cut = written(cut.withColumn("item", F.xxhash64("key", "text_crc32", "size", "piece")), "pieces")
    items = written(cut.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("n_words").alias("tokens"), F.count("*").alias("n_rows")), "items")
    placed = written(cut.join(shards_of(items, shards), "item").select("doc_id", "size", "text_crc32", "key", "nth", "shard"), "placed")
    # slots: row numbers inside small hashed parts of a shard, after what earlier parts hold
    spread = n_rows // (shards * SLOT_ROWS) + 1
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key", "doc_id", "nth"), F.lit(spread)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").count()
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "key", "nth")
    return (placed.withColumn("n", F.row_number().over(inside)).join(offsets, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
