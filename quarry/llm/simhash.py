"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its
word shingles.  Copies share a fingerprint, so comparison works on distinct
fingerprints alone.

Candidates: with a radius of 2, cutting 64 bits into four blocks leaves two of
them equal in any linked pair, so each fingerprint is put into six buckets of
32 equal bits.  A bucket with more than `BUCKET` fingerprints is cut again by
the same argument: its free bits fall into radius + 1 groups, one of which is
equal.  This repeats until buckets are small or have so few free bits that
they cannot be large.  Nothing is capped: every linked pair meets in a bucket.

Comparison: the bit planes of a block of fingerprints are stored vertically,
so a machine word holds one bit of 64 fingerprints.  Distances of many pairs
are counted at once by carry-save adders over the planes (one word for ones,
one for twos), and a block is left as soon as every pair in it has passed the
radius.  Any link found is a true link, whichever bucket its two ends came
from, so small buckets share a block.

Links: a bucket gives the links of a spanning forest, not all its pairs.
Components come from label propagation with pointer jumping over written
tables.

Defined results: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; repeated rows repeat; an empty table gives
an empty one; a component without any doc_id has a null component_id; other
columns are left behind.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, map_arrow, text_blocks, texts_of, written

SHINGLE = 3
RADIUS = 2
BUCKET = 2048
BLOCK = 256
SEED = 42
_HASHES = 1 << 16  # hashes whose bits are unpacked at once

_LOWER = {c: c + 32 for c in range(65, 91)}


def _words(text: str) -> list[bytes]:
    """Words between white space of ASCII, A-Z in lower case."""
    return text.encode().lower().split()


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of k words, repeats included."""
    from xxhash import xxh64_intdigest

    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-k].tolist()]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        part = hashes[at:at + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text) and fp of every document."""

    def run(batch: pa.RecordBatch):
        for block in text_blocks(batch):
            fps = [fingerprint(shingle_hashes(t, k)) for t in texts_of(block)]
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), column(block, "text_key"), pa.array(fps, pa.int64())],
                                             names=["doc_id", "text_key", "fp"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return map_arrow(keyed, run, "doc_id bigint, text_key bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _groups(mask: int, n: int) -> list[int]:
    """The bits of `mask` cut into n groups, low bits first."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def first_masks(radius: int) -> list[int]:
    """Bits held equal by the first buckets: any two of radius + 2 blocks."""
    blocks = _groups((1 << 64) - 1, radius + 2)
    return [a | b for i, a in enumerate(blocks) for b in blocks[i + 1:]]


def _in_buckets(fps: DataFrame, parents: dict[int, list[int]] | None, masks: list[int]) -> DataFrame:
    """A row (mask, bits, fp) for each bucket of each fingerprint."""

    def buckets(some: list[int]) -> Column:
        return F.array(*[F.struct(F.lit(_signed(m)).cast("bigint").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("bits")) for m in some])

    if parents is None:
        return fps.select("fp", F.explode(buckets(masks)).alias("b")).select("b.mask", "b.bits", "fp")
    wanted = F.lit(None)
    for m, children in parents.items():
        wanted = F.when(F.col("mask") == _signed(m), buckets(children)).otherwise(wanted)
    return fps.select("fp", F.explode(wanted).alias("b")).select("b.mask", "b.bits", "fp").distinct()


def bucket_rows(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(mask, bits, fp) of all buckets with two fingerprints or more, none of
    them large: every two distinct fingerprints within the radius meet."""
    masks, parents = first_masks(radius), None
    done: list[DataFrame] = []
    level = fps
    while True:
        level = written(_in_buckets(level, parents, masks), "buckets")
        sizes = written(level.groupBy("mask", "bits").count().where("count > 1"), "bucket-sizes")
        free = max(64 - m.bit_count() for m in masks)
        small = sizes if (1 << free) <= 8 * bucket else sizes.where(F.col("count") <= bucket)
        done.append(level.join(small, ["mask", "bits"], "left_semi"))
        large = sizes.where(F.col("count") > bucket)
        if (1 << free) <= 8 * bucket or large.isEmpty():
            break
        parents = {m: [m | g for g in _groups(~m & (1 << 64) - 1, radius + 1)] for m in masks}
        masks = sorted({c for children in parents.values() for c in children})
        level = level.join(large, ["mask", "bits"], "left_semi").select("mask", "fp")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes over the fingerprints, as words of 64 lanes."""
    bits = np.unpackbits(np.pad(fps.astype("<u8"), (0, -len(fps) % 64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close_pairs(left: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs at `radius` (0 to 3) or fewer differing bits;
    without `right`, of the pairs i < j within `left`."""
    other = left if right is None else right
    planes = planes_of(other)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    ones = np.zeros((len(left), planes.shape[1]), np.uint64)
    twos = np.zeros_like(ones)
    # lanes that are out: padding, and what is not i < j
    out = np.ones((len(left), planes.shape[1] * 64), np.uint8)
    out[:, :len(other)] = np.tri(len(left), dtype=np.uint8) if right is None else 0
    past = np.packbits(out, axis=1, bitorder="little").view("<u8")
    for bit in range(64):
        differ = planes[bit][None, :] ^ np.where(left >> np.uint64(bit) & np.uint64(1), full, np.uint64(0))[:, None]
        carry = ones & differ
        ones ^= differ
        fours = twos & carry
        twos ^= carry
        past |= fours | (ones | twos, twos, ones & twos, fours)[radius]
        if bit & 3 == 3 and bool((past == full).all()):
            break  # every pair has passed the radius
    return np.nonzero(np.unpackbits(np.ascontiguousarray(~past).view(np.uint8), axis=1, bitorder="little"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the given links among n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect what the radius connects, from distinct fps."""

    def compared(values: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        for i in range(0, len(values), block):
            left = values[i:i + block]
            for j in range(i, len(values), block):
                a, b = close_pairs(left, None if i == j else values[j:j + block], radius)
                found += [(x + i, y + j) for x, y in zip(a.tolist(), b.tolist())]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        kept = np.array(forest(len(values), pairs[:, 0], pairs[:, 1]), np.int64).reshape(-1, 2)
        signed = values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[kept[:, 0]]), pa.array(signed[kept[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            rows = np.stack([column(batch, c).to_numpy() for c in ("mask", "bits", "fp")], axis=1)
            held = np.concatenate([held, rows])
            cuts = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1  # whole buckets end here
            start = 0
            for here, after in zip(cuts, np.append(cuts[1:], len(held) + block)):
                if after - start > block:  # the next bucket would not fit into this block
                    yield compared(np.unique(held[start:here, 2].view(np.uint64)))
                    start = here
            held = held[start:]
        if len(held):
            yield compared(np.unique(held[:, 2].view(np.uint64)))

    rows = bucket_rows(fps, radius, bucket).repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return rows.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the root names the component of every linked fp."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m")).select("fp", F.least("fp", "m").alias("root")), "labels")
    while True:
        # the least root next to a fingerprint; the least of those for all that share its root
        near = (both.join(labels.select(F.col("fp").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near")))
        seen = labels.join(near, "fp").select("fp", "root", F.least("root", "near").alias("least"))
        hooked = seen.groupBy("root").agg(F.min("least").alias("up"))
        moved = seen.join(hooked, "root").select("fp", F.least("least", "up").alias("root"))
        moved = written(moved, "moved")
        jump = moved.select(F.col("fp").alias("root"), F.col("root").alias("top"))
        after = written(moved.join(jump, "root").select("fp", F.least("root", "top").alias("root")), "labels")
        same = after.join(labels.select("fp", F.col("root").alias("was")), "fp").where("root <> was").isEmpty()
        labels = after
        if same:
            return labels


def grouped(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp, component_id, keep_key: the component's least
    doc_id, and the text key of the row that stands for the component (of a
    component without any doc_id, its least text key)."""
    rows = written(fingerprints(docs, k), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    distinct = written(rows.groupBy("fp").agg(F.min(row).alias("first")), "distinct-fps")
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    of_fp = named.join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("keep_key"))
    return rows.join(of_fp, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: that with the least doc_id, or, where
    no member has a doc_id, one with the least text key."""
    kept = written(grouped(docs).select("component_id", "keep_key").distinct(), "keepers")
    key = "text_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("text"))
    named = kept.where("component_id IS NOT NULL").select(F.col("component_id").alias("doc_id"), F.col("keep_key").alias(key))
    nameless = kept.where("component_id IS NULL").select(F.col("keep_key").alias(key))
    stay = keyed.join(named, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    alone = keyed.where("doc_id IS NULL").join(nameless, key, "left_semi").select(keyed.columns).dropDuplicates([key])
    return stay.select(keyed.columns).unionByName(alone).select(*docs.columns)
