"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark item (question and answer alike) is normalised to words, and
its windows of `WINDOW` consecutive words (or the whole item, if it has fewer)
are the patterns of one automaton.  A document is normalised the same way
while the offsets of its words are kept, scanned once, and each occurrence is
mapped back through those offsets to word positions and character spans of
the original text.

The automaton is built by each Python worker from the benchmark's words.
Those are sent to the executors, so their size is summed first: items go out
in packs of at most `PACK_BYTES` of text, one scan of the documents for each
pack (a benchmark of any usual size is one pack), and the hits of several
packs are joined by text (equal texts have equal hits).

Words are runs of what is left when ASCII other than digits and letters is
taken away; A-Z are lower-cased.

Defined results: a null text has no words; an item without words has no
windows; equal item_ids count once; repeated rows repeat; an empty table gives
an empty one, an empty benchmark no hits; other columns are left behind.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, map_arrow, text_blocks, texts_of, written

WINDOW = 10
#: Benchmark text in one automaton (about 100 times that in a worker's memory).
PACK_BYTES = 2_000_000

_NORMAL = {c: " " for c in range(128)} | {c: chr(c) for c in (*range(48, 58), *range(97, 123))} | {c: chr(c + 32) for c in range(65, 91)}


def normalised(text: str) -> str:
    """The text with its non-word characters as spaces: offsets stay."""
    return text.translate(_NORMAL)


def words_of(text: str) -> list[str]:
    return [w for w in normalised(text).split(" ") if w]


def patterns(items: list[tuple[int, str]], window: int = WINDOW) -> dict[str, tuple[int, set[int]]]:
    """Windows between spaces: how many words, and whose they are."""
    out: dict[str, tuple[int, set[int]]] = {}
    for item_id, text in items:
        words = words_of(text or "")
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            out.setdefault(f" {' '.join(words[i:i + size])} ", (size, set()))[1].add(item_id)
    return out


def automaton(items: list[tuple[int, str]], window: int = WINDOW):
    import ahocorasick

    found = ahocorasick.Automaton()
    for text, (size, ids) in patterns(items, window).items():
        found.add_word(text, (len(text), size, frozenset(ids)))
    found.make_automaton()
    return found


class Scan:
    """One document against an automaton: its words, the runs of hit words,
    and the items found."""

    def __init__(self, scanner, text: str):
        self.words = words_of(text)
        self.items: set = set()
        self.runs: list[list[int]] = []  # half-open, in word positions
        if not len(scanner) or not self.words:
            return
        line = f" {' '.join(self.words)} "
        starts: dict[int, int] | None = None
        for end, (length, size, ids) in scanner.iter(line):
            if starts is None:  # word position by offset of the space before it
                starts = {at: i for i, at in enumerate(accumulate((len(w) + 1 for w in self.words[:-1]), initial=0))}
            first = starts[end - length + 1]
            self.items |= ids
            self.runs.append([first, first + size])
        self.runs = _merged(self.runs)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The runs as character spans of the original text."""
        if not self.runs:
            return []
        flat, at, offsets = normalised(text), 0, []
        for word in self.words:
            at = flat.index(word, at)
            offsets.append((at, at + len(word)))
            at += len(word)
        return [(offsets[a][0], offsets[z - 1][1]) for a, z in self.runs]


def item_packs(benchmark: DataFrame, limit: int = PACK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in packs of at most `limit` bytes of text (an
    item over it is a pack of its own), one pack at the driver at a time."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // limit + 1
    if n == 1:
        yield [tuple(r) for r in items.collect()]
        return
    dealt = written(items.withColumn("pack", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n))), "benchmark-packs")
    for k in range(2 * n):
        yield [tuple(r) for r in dealt.where(F.col("pack") == k).select("item_id", "text").collect()]


_AUTOMATA: dict[str, object] = {}


def _scanner(sent):
    """The automaton of a broadcast pack, made once in a worker."""
    name, items = sent.value
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = automaton(items)
    return _AUTOMATA[name]


def _merged(runs: list[list[int]]) -> list[list[int]]:
    """Sorted half-open runs without overlap."""
    out: list[list[int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


HITS = "doc_id bigint, text_key bigint, n_words bigint, runs array<array<bigint>>, items array<string>"


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every document its number of words, the runs of hit words and the
    ids of the items found."""
    sc = docs.sparkSession.sparkContext
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))

    def scanned(rows: DataFrame, pack: list[tuple[int, str]], only_hits: bool) -> DataFrame:
        sent = sc.broadcast((uuid.uuid4().hex, pack))

        def run(batch: pa.RecordBatch):
            scanner = _scanner(sent)
            for block in text_blocks(batch):
                scans = [Scan(scanner, t) for t in texts_of(block)]
                out = pa.RecordBatch.from_arrays(
                    [column(block, "doc_id"), column(block, "text_key"), pa.array([len(s.words) for s in scans], pa.int64()),
                     pa.array([s.runs for s in scans], pa.list_(pa.list_(pa.int64()))),
                     pa.array([sorted(map(str, s.items)) for s in scans], pa.list_(pa.string()))],
                    names=["doc_id", "text_key", "n_words", "runs", "items"])
                yield out.filter(pa.array([bool(s.runs) for s in scans])) if only_hits else out

        return map_arrow(rows, run, HITS)

    packs = item_packs(benchmark)
    out = scanned(keyed, next(packs), False)
    more = [written(scanned(keyed, pack, True).select("text_key", "runs", "items").dropDuplicates(["text_key"]), "pack-hits") for pack in packs]
    if not more:
        return out
    found = more[0]
    for part in more[1:]:
        found = found.unionByName(part)
    found = found.groupBy("text_key").agg(F.flatten(F.collect_list("runs")).alias("more_runs"), F.flatten(F.collect_list("items")).alias("more_items"))
    # a text found in several packs: one row for each pack at most
    joined = out.join(found, "text_key", "left")
    return joined.select("doc_id", "text_key", "n_words", F.concat("runs", F.coalesce("more_runs", F.array())).alias("runs"),
                         F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array())))).alias("items"))


DIGEST = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verdict on every document, with the numbers behind it."""

    def run(batch: pa.RecordBatch):
        items = column(batch, "items").to_pylist()
        n_hit = [sum(z - a for a, z in _merged(runs)) for runs in column(batch, "runs").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "n_words"), pa.array(n_hit, pa.int64()), pa.array(list(map(len, items)), pa.int64()),
             pa.array([hashlib.sha256(",".join(ids).encode()).hexdigest() for ids in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return map_arrow(hits(docs, benchmark), run, DIGEST)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    sc, names = docs.sparkSession.sparkContext, docs.columns
    packs = [sc.broadcast((uuid.uuid4().hex, pack)) for pack in item_packs(benchmark)]

    out = docs
    for sent in packs:
        def run(batch: pa.RecordBatch, sent=sent):
            scanner = _scanner(sent)
            for block in text_blocks(batch):
                yield block.filter(pa.array([not Scan(scanner, t).runs for t in texts_of(block)], pa.bool_()))

        out = map_arrow(out, run, docs.schema)
    return out.select(*names)
