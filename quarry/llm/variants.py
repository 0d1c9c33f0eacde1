r"""Spelling variant grouping by finite-state composition.

The near pairs of a vocabulary are what the composition of its acceptor, a
transducer of exactly one edit and the acceptor again accepts.  Before the
edit both acceptors read the same label, so they are in one state; the edit
replaces, deletes or inserts a label; after it they read the same labels
again, and once they meet in one state of the minimised acceptor, whatever
that state accepts completes a pair.

The composition is cut by the state that the common beginning (and end) leads
to.  A pair whose shorter word has m code points, and which differs first at
place p, shares p code points in front and at least m - p - 1 behind: for a
range lo <= p < hi, the words with equal m, equal first lo and equal last
m - hi code points hold every such pair.  Each word goes to two ranges for its
own length and two for being the longer of a pair.  A partition of more than
`SPLIT` words is halved again, until its range is one place; those hold no more
words than the alphabet has letters and pairs of letters.  Nothing is capped.

Each task reads its partitions in order and builds one minimised acceptor for
some thousand words at a time, an initial state for each partition, and lists
the pairs of each initial state.

Defined results: a null text has no words, a null doc_id counts as empty in
the hash; repeated rows count each time; an empty table gives an empty one;
other columns are left behind.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES, DELETE_EVERY = 6, 5, 5, 199
#: Words in a partition before it is halved, and words in one acceptor.
SPLIT = 1024
ACCEPTOR_WORDS = 8192

Linked = tuple  # (what is before, label), or () at the beginning


def _spelt(linked: Linked) -> str:
    out = []
    while linked:
        linked, label = linked
        out.append(label)
    return "".join(reversed(out))


class Acceptor:
    """A minimised acyclic acceptor with several initial states.  Equal states
    of all its partitions are one; states are numbers."""

    def __init__(self) -> None:
        self.final: list[bool] = []
        self.edges: list[dict[str, int]] = []
        self._register: dict[tuple, int] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}

    def _state(self, final: bool, edges: dict[str, int]) -> int:
        key = (final, *edges.items())
        state = self._register.get(key)
        if state is None:
            state = self._register[key] = len(self.final)
            self.final.append(final)
            self.edges.append(edges)
        return state

    def add(self, words: list[str]) -> int:
        """The initial state that accepts these words (sorted, distinct)."""
        open_edges: list[dict[str, int]] = [{}]  # along the last word
        open_final = [False]
        last = ""

        def close(depth: int) -> None:
            for k in range(len(last), depth, -1):
                state = self._state(open_final.pop(), open_edges.pop())
                open_edges[-1][last[k - 1]] = state

        for word in words:
            depth, most = 0, min(len(word), len(last))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            close(depth)
            fresh = len(word) - depth
            open_edges += [{} for _ in range(fresh)]
            open_final += [False] * fresh
            open_final[-1] = True
            last = word
        close(0)
        return self._state(open_final[0], open_edges[0])

    def common(self, x: int, y: int, linked: Linked = ()) -> list[str]:
        """What both states accept, after `linked`."""
        out, stack = [], [(x, y, linked)]
        while stack:
            x, y, linked = stack.pop()
            if self.final[x] and self.final[y]:
                out.append(_spelt(linked))
            if x == y:
                stack += [(z, z, (linked, c)) for c, z in self.edges[x].items()]
            else:
                other = self.edges[y]
                stack += [(z, other[c], (linked, c)) for c, z in self.edges[x].items() if c in other]
        return out

    def edits(self, q: int) -> list[tuple[str, str]]:
        """The rests of all pairs that differ first behind this state."""
        out = self._edits.get(q)
        if out is None:
            out, edges = [], self.edges[q]
            for (a, x), (b, y) in combinations(edges.items(), 2):
                out += [(a + s, b + s) for s in self.common(x, y)]
            for a, x in edges.items():  # one word has a here, the other goes on without it
                if self.final[x] and self.final[q]:
                    out.append((a, ""))
                after = self.edges[x]
                for c, y in edges.items():
                    if c != a and c in after:
                        out += [(a + s, s) for s in self.common(after[c], y, ((), c))]
            self._edits[q] = out
        return out

    def pairs(self, initial: int, lo: int, hi: int, least: int) -> Iterator[tuple[str, str]]:
        """The pairs from an initial state that differ first at lo <= place <
        hi and whose shorter word has `least` code points."""
        stack: list[tuple[int, int, Linked]] = [(initial, 0, ())]
        while stack:
            q, depth, linked = stack.pop()
            if depth >= lo and (found := self.edits(q)):
                begin = _spelt(linked)
                for u, v in found:
                    if depth + min(len(u), len(v)) == least:
                        yield begin + u, begin + v
            if depth + 1 < hi:
                stack += [(z, depth + 1, (linked, c)) for c, z in self.edges[q].items()]


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): the damaged lower-cased runs with their occurrences."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    runs = runs.select(F.when(h % DELETE_EVERY == 0, without).otherwise(F.col("run")).alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n"))


def _range(m: Column, lo: Column, hi: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, hi) with the hash of what a partition shares."""
    shared = F.xxhash64("m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.right("word", F.greatest(F.col("m") - F.col("hi"), F.lit(0))))
    return rows.withColumn("key", shared)


def _halves(m: Column, lo: Column, hi: Column) -> Column:
    mid = F.floor((lo + hi) / 2)
    return F.array(_range(m, lo, mid), _range(m, mid, hi))


def partitions(vocabulary: DataFrame, split: int = SPLIT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows (word, n, m, lo, hi, key): each word in its partitions."""
    n = F.length("word")
    halves = lambda m: _halves(m, F.lit(0), m + 1)
    longer = F.when(n > least_length, halves(n - 1)).otherwise(F.expr("CAST(array() AS array<struct<m:int,lo:int,hi:int>>)"))
    todo = _keyed(vocabulary.select("word", "n", F.explode(F.concat(halves(n), longer)).alias("r")).select("word", "n", "r.*"))
    done = []
    while True:
        large = written(todo.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > split).select("key"), "variants-large")
        if large.isEmpty():
            break
        done.append(todo.join(large, "key", "left_anti"))
        again = todo.join(large, "key", "left_semi")
        again = again.select("word", "n", F.explode(_halves(F.col("m"), F.col("lo"), F.col("hi"))).alias("r")).select("word", "n", "r.*")
        todo = written(_keyed(again), "variants-halved")
    for d in done:
        todo = todo.unionByName(d)
    return todo


def near_pairs(vocabulary: DataFrame, split: int = SPLIT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, other, other_n) for both words of each near pair of a vocabulary
    (word, n) of distinct words of at least `least_length` code points."""
    rows = partitions(vocabulary, split, least_length).repartition("key").sortWithinPartitions("key", "m", "lo", "hi", "word")

    def found(groups: list[tuple[tuple, list[str]]], counts: dict[str, int]) -> pa.RecordBatch:
        acceptor, words, others = Acceptor(), [], []
        initial = [(key, acceptor.add(members)) for key, members in groups if len(members) > 1]
        for (_, m, lo, hi), state in initial:
            for u, v in acceptor.pairs(state, lo, hi, m):
                words += (u, v)
                others += (v, u)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(others, pa.string()), pa.array(list(map(counts.__getitem__, others)), pa.int64())],
                                          names=["word", "other", "other_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[tuple, list[str]]] = []
        counts: dict[str, int] = {}
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "m", "lo", "hi", "word", "n")]
            for key, m, lo, hi, word, n in zip(*columns):
                k = (key, m, lo, hi)
                if not groups or groups[-1][0] != k:
                    if len(counts) >= ACCEPTOR_WORDS:
                        yield found(groups, counts)
                        groups, counts = [], {}
                    groups.append((k, []))
                groups[-1][1].append(word)
                counts[word] = n
        if groups:
            yield found(groups, counts)

    return rows.mapInArrow(run, "word string, other string, other_n bigint")


def with_forms(vocabulary: DataFrame, pairs: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """Add form, form_n and n_near: the most frequent near word, if it has at
    least `times` the occurrences, and the number of near words."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), "other")).alias("best"))
    rows = vocabulary.join(best, "word", "left")
    takes = -F.col("best.least") >= times * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                       F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.least")).alias("form_n"))


def with_roots(rows: DataFrame) -> DataFrame:
    """Add root: the last word that forms lead to from each word.  A form is
    more frequent than its word, so there are no rings; each round doubles
    the steps taken."""
    steps = written(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "variants-steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        steps = written(steps.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "variants-steps")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return rows.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def groups(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """Every frequent word with its form, the root of its group and counts."""
    vocabulary = written(words_of(docs).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)), "variants-words")
    rows = written(with_forms(vocabulary, near_pairs(vocabulary, split)), "variants-forms")
    return with_roots(rows).select("word", "form", "root", F.col("n").cast("bigint").alias("n"), "n_near", "form_n")
