import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from tests.llm.conftest import ROWS


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates(awkward, nothing):
    fps = [brute_fingerprint(t) for _, t in ROWS]
    comps = brute_components([i for i, _ in ROWS], fps)
    want = sorted([(i, f"{f:016x}", c) for (i, _), f, c in zip(ROWS, fps, comps)], key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(awkward).collect()), key=str) == want
    assert simhash.near_duplicates(nothing).collect() == []


def test_one_of_each(awkward, nothing):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    # rows 1 and 2 are equal, 3 to 5 have no words, 8 is there twice; of the two without an id, one equals 3
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([1, 3, 6, 7, 8, 9, -5, 10, None], key=str)
    assert simhash.one_of_each(nothing).collect() == []


def test_one_of_each_without_ids(spark):
    """Copies without an id go with a copy that has one; without any, one of them stays."""
    t, u = "a text that is here four times over", "another text that nobody has numbered"
    df = spark.createDataFrame([(1, t), (None, t), (None, t), (2, t), (None, u), (None, u), (3, "a third text with a number")], "doc_id bigint, text string").repartition(3)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each(df).collect()) == sorted([(1, t), (0, u), (3, "a third text with a number")])


def test_close_pairs_against_brute_force():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4)]
    v = np.concatenate([base, *flips])
    for radius in range(4):
        want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (int(v[i]) ^ int(v[j])).bit_count() <= radius}
        a, b = simhash.close_pairs(v, None, radius)
        assert set(zip(a.tolist(), b.tolist())) == want
        a, b = simhash.close_pairs(v[:70], v[70:], radius)
        assert set(zip(a.tolist(), (b + 70).tolist())) == {p for p in want if p[0] < 70 <= p[1]}


def test_hot_buckets_are_cut_and_lose_no_link(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    fps = {centre}
    while len(fps) < 500:  # one dense cloud: most share 32 bits with many others
        fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    fps |= {r.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = simhash.links(df, 2, bucket=20, block=32)
    got = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
    comps = brute_components(list(range(len(fps))), fps)
    mine = [got.get(f, f) for f in signed]
    groups = lambda x: sorted(sorted(i for i in range(len(x)) if x[i] == v) for v in set(x))
    assert groups(mine) == groups(comps)


def test_long_chain_is_one_component(spark):
    n = 60
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
