"""Spelling variants against plain comparison of all words."""
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, variants
from tests.llm.conftest import LONG, ROWS

FEW = "aeér"


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            out[run] += 1
    return out


def near(words):
    """One edit away, by leaving out or replacing each code point."""
    words, out = set(words), defaultdict(set)
    alphabet = {c for w in words for c in w}
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in words:
                out[w].add(v)
                out[v].add(w)
            out[w] |= {x for c in alphabet if c != w[i] and (x := w[:i] + c + w[i + 1:]) in words}
    return out


def expected(rows):
    n = {w: c for w, c in counted(rows).items() if len(w) >= 6 and c >= 5}
    close, form = near(n), {}
    for w in n:
        if close[w]:
            best = min(close[w], key=lambda v: (-n[v], v))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None)
    return out


def vocabulary(spark, words):
    return spark.createDataFrame([(w, i + 5) for i, w in enumerate(words)], "word string, n bigint").repartition(6)


@pytest.mark.parametrize("split", [2, 7, 1024])
def test_pairs_equal_plain_comparison(spark, split):
    rng = random.Random(split)
    words = {"".join(rng.choice(FEW) for _ in range(rng.randrange(6, 10))) for _ in range(3000)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "a" * 40, "a" * 41, "éaaaaa", "aaaaaé", "÷×aaaa", "÷×aaaaa"}
    got = variants.near_pairs(vocabulary(spark, sorted(words)), split).collect()
    want = near(words)
    pairs = [(r["word"], r["other"]) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(w, v) for w, vs in want.items() for v in vs}
    n = {w: i + 5 for i, w in enumerate(sorted(words))}
    assert all(r["other_n"] == n[r["other"]] for r in got)


def test_a_partition_with_most_words_is_halved(spark):
    """Words that share their beginning and their end, with letters in the middle."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"commonstart{a}{b}{c}commonend" for a in letters for b in letters[:12] for c in letters[:6]]
    words += [f"commonstart{a}{b}commonend" for a in letters for b in letters[:12]]
    df = vocabulary(spark, words)
    sizes = [r["count"] for r in variants.partitions(df, 100).groupBy("key").count().collect()]
    assert max(sizes) < 400  # the beginning alone is shared by all
    got = {(r["word"], r["other"]) for r in variants.near_pairs(df, 100).collect()}
    assert got == {(w, v) for w, vs in near(words).items() for v in vs}


def test_acceptor_is_minimal():
    a = variants.Acceptor()
    first, second = a.add(["tap", "taps", "top", "tops"]), a.add(["tip", "tips", "top", "tops"])
    assert len(a.final) == 7  # two initial states, what follows t in each, and shared: in front of p, behind p, the end
    assert sorted(a.common(first, second)) == ["top", "tops"]
    assert a.add(["tap", "taps", "top", "tops"]) == first


def test_groups_of_documents(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(6, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = [rng.choice(base[:6] if rng.random() < 0.6 else base) for _ in range(30)]
        words = [w if rng.random() < 0.8 else (w[:2] + rng.choice("abé") + w[3:] if rng.random() < 0.5 else w[:3] + w[4:]) for w in words]
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(None, "Größte Größte " * 40), (None, None), (7, ""), (8, " ".join(base)), (8, " ".join(base))]
    rows += [(900 + i, " ".join(["zzzzzz"] * 6 + ["zzzzzzz"] * 40 + ["zzzzzzzz"] * 260)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.groups(df, 16).collect()}
    want = expected(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert any(v[0] and v[0] != v[1] for v in want.values())


def test_forms_are_followed_to_the_last(spark):
    chain = [("aaaaaa" + "b" * i, 5 * 6 ** i) for i in range(9)]
    df = spark.createDataFrame([(w, n, 0, chain[i + 1][0] if i + 1 < len(chain) else None, None) for i, (w, n) in enumerate(chain)],
                               "word string, n bigint, n_near bigint, form string, form_n bigint")
    assert {r["root"] for r in variants.with_roots(df).collect()} == {chain[-1][0]}


def test_given_table_and_awkward_rows(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries()["op12_spelling_variants"](spark, "/root/testdata/sf0.001").collect()}
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()]) and len(got) > 100
    clashing = awkward.withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("root", F.lit(None).cast("string"))
    more = [(i, LONG.replace("wort", "wörter")) for i in range(2)]
    rows = ROWS + more
    both = clashing.select("doc_id", "text", "word", "n", "root").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    assert {r["word"]: r["n"] for r in variants.groups(both).collect()} == {w: v[2] for w, v in expected(rows).items()}
    assert variants.groups(nothing).collect() == []


def test_very_long_words_take_time_by_their_length(spark):
    rng = random.Random(1)
    word = "".join(rng.choice("abc") for _ in range(60_000))
    words = [word, word[:30_000] + "x" + word[30_001:], word + "a", word[1:], "y" + word[1:]]
    t = time.time()
    got = {(r["word"], r["other"]) for r in variants.near_pairs(vocabulary(spark, words)).collect()}
    want = {(0, 1), (0, 2), (0, 3), (0, 4), (3, 4)}
    assert got == {(words[a], words[b]) for p in want for a, b in (p, p[::-1])}
    assert time.time() - t < 60
