r"""Conversation repair: faults found, and the cheapest edits that restore a
dialogue of the form `(s?(ua)+)?`.

Rows of a conversation stand in order of turn (nulls first).  A blank or
repeated row must go (Delete, 3); any row may go; a row stays (Keep, 0) where
its role fits, takes the role that fits (Rerole, 2), and an empty message of
the role that fits may be put in anywhere (Insert, 2); a truncated row that
stays adds 1.

The states of the grammar and the places between rows are the nodes of a
graph whose arcs are edits.  A conversation is cut into blocks of at most
`BLOCK_ROWS` rows, so that no task holds a long one:

1. a block's least costs from each state at its start to each at its end are a
   4 x 4 matrix; costs to go at the block ends follow from the matrices alone;
2. inside each block, with its costs to go, the arcs on cheapest paths remain.
   Prefix doubling ranks their nodes: by the initial of the first edit, then by
   the first 2, 4, 8, ... edits of the audit that begins there, each round from
   the ranks of a node and of the node its doubled pointer leads to.  The ranks
   select each node's arc, and doubled pointers spell the least audit from
   each of the four states a block may be entered in;
3. the states in which blocks are entered follow from those four exits.

Only the last step, the hash of the repaired text, has to read a conversation
in one sequence (that is how SHA-256 is defined); it streams over sorted rows
and holds one at a time.

Equal rows of one turn are one element with a count: all but the first must be
deleted, and Delete comes before any other initial.

Defined results: a null conversation is one conversation; a null role or text
is one space; rows of one turn go by role, by the first 64 code points of the
text and then by the SHA-256 of both; an initial is the role's first
character, a role without one never fits; repeated rows repeat; a conversation
without rows gives zeros, an empty audit and the hash of the empty string; an
empty table gives an empty one; other columns are left behind.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, written

BLOCK_ROWS = 4096
DROP, EMPTY, UNSTOP, REPEAT, TO_USER = range(5)
STATES = 4  # nothing yet, after system, after user, after assistant
FITS = (2, 2, 3, 2)  # where a message of the role that fits leads
KEEPS = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Initials in their ASCII order; 0 is the end of an audit.
INITIALS = ".DIKR"
D, I, K, R = 1, 2, 3, 4  # noqa: E741

Element = tuple[str, int, int]  # initial of the role, 0 whole 1 truncated 2 to be deleted, rows


# the plain parts: one block


def settled(c: list[int]) -> list[int]:
    """Costs to go at a place where messages may still be inserted."""
    two, three = min(c[2], c[3] + 2), min(c[3], c[2] + 2)
    return [min(c[0], two + 2), min(c[1], two + 2), two, three]


#: Costs to go behind the last row.
AT_END = settled([0, FAR, FAR, 0])


def before_row(element: Element, after: list[int]) -> list[int]:
    """Costs to go in front of an element, from those behind it."""
    initial, fault, n = element
    if fault == 2:
        return settled([c + 3 * n for c in after])
    keeps = KEEPS.get(initial, (-1, -1, -1, -1))
    return settled([min(after[s] + 3, after[FITS[s]] + 2 + fault, after[keeps[s]] + fault if keeps[s] >= 0 else FAR) for s in range(STATES)])


def matrix(elements: list[Element]) -> list[int]:
    """Least cost from each state before the block to each behind it."""
    columns = []
    for t in range(STATES):
        c = [0 if s == t else FAR for s in range(STATES)]
        for e in reversed(elements):
            c = before_row(e, c)
        columns.append(c)
    return [min(columns[t][s], FAR) for s in range(STATES) for t in range(STATES)]


def optimal_arcs(elements: list[Element], after: list[int], last: bool) -> tuple[list[int], list[int], list[int]]:
    """Node, initial and target of the arcs on cheapest paths.  Node 4 * i + s
    stands in front of element i in state s; behind the last element a path
    goes on only where the conversation ends."""
    costs = [after]
    for e in reversed(elements):
        costs.append(before_row(e, costs[-1]))
    costs.reverse()
    nodes, labels, targets = [], [], []

    def arc(i: int, s: int, label: int, j: int, t: int, cost: int) -> None:
        if t >= 0 and costs[i][s] == cost + costs[j][t]:
            nodes.append(STATES * i + s)
            labels.append(label)
            targets.append(STATES * j + t)

    for i, (initial, fault, n) in enumerate(elements):
        for s in range(STATES):
            arc(i, s, D, i + 1, s, 3 * n if fault == 2 else 3)
            arc(i, s, I, i, FITS[s], 2)
            if fault < 2:
                arc(i, s, K, i + 1, KEEPS.get(initial, (-1,) * STATES)[s], fault)
                arc(i, s, R, i + 1, FITS[s], 2 + fault)
    if last:
        for s in (1, 2):
            arc(len(elements), s, I, len(elements), FITS[s], 2)
    return nodes, labels, targets


def ranked(size: int, node: np.ndarray, label: np.ndarray, target: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The arc that the least audit takes from each node: its initial (0 where
    no arc leaves) and target (itself there).

    Ranks by one edit, doubled until they cover `steps`; an initial decides
    where an edit leads, so equal ranks mean equal audits of that length."""
    order = np.lexsort((label, node))
    first = order[np.unique(node[order], return_index=True)[1]]
    rank, to = np.zeros(size, np.int64), np.arange(size)
    rank[node[first]], to[node[first]] = label[first], target[first]
    length = 1
    while length < steps:
        rank = np.unique(rank * (rank.max() + 1) + rank[to], return_inverse=True)[1]
        to, length = to[to], 2 * length
    order = np.lexsort((rank[target], label, node))
    best = order[np.unique(node[order], return_index=True)[1]]
    initial, to = np.zeros(size, np.int64), np.arange(size)
    initial[node[best]], to[node[best]] = label[best], target[best]
    return initial, to


def least_audits(blocks: list[tuple[list[Element], list[int], bool]]) -> list[list[tuple[int, str]]]:
    """For each block and each state before it: the state behind it and the
    least audit, one initial for each element or insertion.  The blocks are
    ranked together."""
    node, label, target, start = [], [], [], [0]
    for elements, after, last in blocks:
        n, lab, t = optimal_arcs(elements, after, last)
        node += [start[-1] + x for x in n]
        label += lab
        target += [start[-1] + x for x in t]
        start.append(start[-1] + STATES * (len(elements) + 1))
    longest = max((3 * (len(e) + 1) for e, _, _ in blocks), default=1)
    initial, to = ranked(start[-1], np.array(node, np.int64), np.array(label, np.int64), np.array(target, np.int64), longest)
    pointers, length = [to], 1
    while length < longest:
        pointers.append(pointers[-1][pointers[-1]])
        length *= 2
    out = []
    for (elements, _, _), a in zip(blocks, start):
        path, k = np.arange(a, a + STATES)[:, None], 0
        while (initial[path[:, -1]] > 0).any():  # doubled pointers: the nodes at places 0 .. 2^k - 1
            path, k = np.concatenate([path, pointers[k][path]], 1), k + 1
        spelt = initial[path]
        out.append([(int(path[s, -1] - a) % STATES, "".join(map(INITIALS.__getitem__, spelt[s][spelt[s] > 0].tolist()))) for s in range(STATES)])
    return out


def repairs(elements: list[Element], state: int, audit: str) -> tuple[str, list[list[str]], list[str | None], list[str]]:
    """The audit with one initial for each row, and what each element becomes:
    roles inserted in front, and its role (None where it is deleted, empty
    where it stays as it is); then the roles inserted behind all."""
    spelt, inserted, roles, held, at = [], [], [], [], 0
    for c in audit:
        if c == "I":
            state = FITS[state]
            held.append(ROLE[state])
            spelt.append(c)
            continue
        initial, fault, n = elements[at]
        inserted.append(held)
        held = []
        spelt.append(c * n if fault == 2 else c)
        if c == "K":
            state = KEEPS[initial][state]
        elif c == "R":
            state = FITS[state]
        roles.append({"D": None, "K": ""}.get(c, ROLE.get(state)))
        at += 1
    return "".join(spelt), inserted, roles, held


# on Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(`conv_id:turn`) % 20; `copies` counts
    what the damage and equal rows make of one."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    rows = conversations.select(conversation().alias("conv"), F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"), said("role").alias("role"), said("text").alias("text"))
    text = F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNSTOP, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where(F.col("kind") != DROP).select(
        "conv", "turn", F.when(F.col("kind") == TO_USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == REPEAT, 2).otherwise(1).cast("bigint").alias("copies"))


def conversation() -> Column:
    """The conversation as text, null apart from any other."""
    return F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))


def faulted(rows: DataFrame) -> DataFrame:
    """Distinct rows with their count and the first fault of the first copy."""
    key = ["conv", "timed", "turn", "role", "text"]
    rows = rows.select("conv", F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "copies")
    rows = rows.groupBy(*key).agg(F.sum("copies").alias("copies"))
    # the first of equal rows of other turns: joined on whole keys, so that a frequent message is no hot key
    first = rows.groupBy("conv", "role", "text").agg(F.min(F.struct("timed", "turn")).alias("at")).select("conv", "at.timed", "at.turn", "role", "text", F.lit(True).alias("first"))
    rows = rows.join(first, key, "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return rows.withColumn("fault", F.when(blank, "blank").when(F.col("first").isNull(), "duplicate").when(cut, "truncated").otherwise("none")).drop("first")


def blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows with the number of their range and block and their place in it; a
    range is a stretch of the whole order, so a long conversation has many."""
    digest = F.sha2(F.concat_ws("\x00", "role", "text"), 256)
    order = ["timed", "turn", "_role", "_text", "_digest"]
    rows = rows.select("*", F.left("role", F.lit(64)).alias("_role"), F.left("text", F.lit(64)).alias("_text"), digest.alias("_digest"))
    rows = written(rows.repartitionByRange("conv", *order).withColumn("range", F.spark_partition_id()), "repair-rows")
    place = F.row_number().over(Window.partitionBy("range", "conv").orderBy(*order)) - 1
    return rows.withColumn("place", place).withColumn("block", F.floor(F.col("place") / block_rows)).drop("_role", "_text", "_digest")


CODE = "struct<place:int,initial:string,fault:int,n:bigint>"


def _elements(codes: list[dict]) -> tuple[list[Element], list[tuple[int, bool]]]:
    """The elements of a block, and the row (place, first copy) of each."""
    elements, rows = [], []
    for c in codes:
        elements.append((c["initial"], c["fault"], c["n"] if c["fault"] == 2 else 1))
        rows.append((c["place"], True))
        if c["fault"] < 2 and c["n"] > 1:
            elements.append((c["initial"], 2, c["n"] - 1))
            rows.append((c["place"], False))
    return elements, rows


def _batches(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _map(df: DataFrame, fn, ddl: str) -> DataFrame:
    """`fn` from the rows of a batch to rows; parses the schema on the driver."""
    schema = _arrow(ddl)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _batches(fn(batch.to_pylist()), schema)

    return map_arrow(df, run, ddl)


BLOCK_KEY = "conv string, range int, block bigint"


def _outline(rows: list[dict]) -> list[dict]:
    out = []
    for r in rows:
        elements, _ = _elements(r["codes"])
        pairs = sum(a[0] + b[0] not in LEGAL for a, b in zip(elements, elements[1:])) + sum((n - 1) * (c * 2 not in LEGAL) for c, _, n in elements)
        out.append({"conv": r["conv"], "range": r["range"], "block": r["block"], "costs": matrix(elements), "illegal": pairs,
                    "head": elements[0][0], "tail": elements[-1][0]})
    return out


def _to_go(rows: list[dict]) -> list[dict]:
    """Costs to go behind each block of a conversation."""
    out = []
    for r in rows:
        blocks, after, ends = sorted(r["blocks"], key=lambda b: (b["range"], b["block"])), AT_END, []
        for b in reversed(blocks):
            ends.append(after)
            m = b["costs"]
            after = [min(m[STATES * s + t] + after[t] for t in range(STATES)) for s in range(STATES)]
        illegal = sum(b["illegal"] for b in blocks) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(blocks, blocks[1:]))
        out.append({"conv": r["conv"], "cost": after[0], "illegal": illegal,
                    "ends": [{"range": b["range"], "block": b["block"], "after": e, "last": i == len(blocks) - 1} for i, (b, e) in enumerate(zip(blocks, reversed(ends)))]})
    return out


def _audits(rows: list[dict]) -> list[dict]:
    work = [(_elements(r["codes"])[0], r["after"], r["last"]) for r in rows]
    return [{"conv": r["conv"], "range": r["range"], "block": r["block"], "exits": [x for x, _ in found], "audits": [a for _, a in found]}
            for r, found in zip(rows, least_audits(work))]


def _entries(rows: list[dict]) -> list[dict]:
    """The state in which each block of a conversation is entered."""
    out = []
    for r in rows:
        state, found = 0, []
        for b in sorted(r["blocks"], key=lambda b: (b["range"], b["block"])):
            found.append({"range": b["range"], "block": b["block"], "state": state})
            state = b["exits"][state]
        out.append({"conv": r["conv"], "entries": found})
    return out


def _plans(rows: list[dict]) -> list[dict]:
    out = []
    for r in rows:
        elements, places = _elements(r["codes"])
        audit, inserted, roles, behind = repairs(elements, r["state"], r["audit"])
        edits = [{"place": p, "before": b, "role": role, "after": []} for (p, _), b, role in zip(places, inserted, roles) if role is not None or b]
        if behind:
            edits.append({"place": places[-1][0], "before": [], "role": None, "after": behind})
        out.append({"conv": r["conv"], "range": r["range"], "block": r["block"], "audit": audit, "edits": edits})
    return out


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(audits, messages) of the conversations after damage: a row per
    conversation that still has rows, and a row per repaired message with the
    keys (range, block, place, part) that order it."""
    rows = blocked(faulted(damaged(conversations)), block_rows)
    code = F.struct("place", F.substring("role", 1, 1).alias("initial"),
                    F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0).alias("fault"), F.col("copies").alias("n"))
    is_ = lambda f: F.col("fault") == f
    copies = F.col("copies")
    key = ["conv", "range", "block"]
    # at most block_rows codes to a list
    codes = written(rows.groupBy(*key).agg(
        F.sort_array(F.collect_list(code.cast(CODE))).alias("codes"), F.sum(F.when(is_("blank"), copies).otherwise(0)).alias("blank"),
        F.sum(F.when(is_("duplicate"), copies).when(is_("blank"), 0).otherwise(copies - 1)).alias("duplicate"), F.sum(is_("truncated").cast("bigint")).alias("truncated")), "repair-codes")
    bare = codes.select(*key, "codes")
    outline = _map(bare, _outline, f"{BLOCK_KEY}, costs array<bigint>, illegal bigint, head string, tail string")
    ends = written(_map(outline.groupBy("conv").agg(F.collect_list(F.struct("range", "block", "costs", "illegal", "head", "tail")).alias("blocks")), _to_go,
                        "conv string, cost bigint, illegal bigint, ends array<struct<range:int,block:bigint,after:array<bigint>,last:boolean>>"), "repair-ends")
    behind = ends.select("conv", F.explode("ends").alias("e")).select("conv", "e.range", "e.block", "e.after", "e.last")
    audits = written(_map(bare.join(behind, key), _audits, f"{BLOCK_KEY}, exits array<int>, audits array<string>"), "repair-audits")
    entries = _map(audits.groupBy("conv").agg(F.collect_list(F.struct("range", "block", "exits")).alias("blocks")), _entries,
                   "conv string, entries array<struct<range:int,block:bigint,state:int>>")
    entered = entries.select("conv", F.explode("entries").alias("e")).select("conv", "e.range", "e.block", "e.state")
    chosen = audits.join(entered, key).select(*key, "state", F.get("audits", F.col("state")).alias("audit"))
    plans = written(_map(bare.join(chosen, key), _plans,
                         f"{BLOCK_KEY}, audit string, edits array<struct<place:int,before:array<string>,role:string,after:array<string>>>"), "repair-plans")
    whole = plans.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "block", "audit"))), lambda b: b["audit"]), "").alias("audit"))
    faults = codes.groupBy("conv").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")])
    audits_of = whole.join(faults, "conv").join(ends.select("conv", "cost", "illegal"), "conv")
    edits = plans.select(*key, F.explode("edits").alias("e")).select(*key, "e.place", F.posexplode(F.concat(
        F.transform("e.before", lambda x: F.struct(F.lit(0).alias("kind"), x.alias("role"))), F.when(F.col("e.role").isNotNull(), F.array(F.struct(F.lit(1).alias("kind"), F.col("e.role").alias("role"))))
        .otherwise(F.expr("CAST(array() AS array<struct<kind:int,role:string>>)")), F.transform("e.after", lambda x: F.struct(F.lit(2).alias("kind"), x.alias("role"))))).alias("part", "edit"))
    messages = edits.join(rows.select(*key, "place", F.col("role").alias("old"), "text"), [*key, "place"]).select(
        *key, "place", F.col("edit.kind").alias("kind"), "part",
        F.when((F.col("edit.kind") == 1) & (F.col("edit.role") == ""), F.col("old")).otherwise(F.col("edit.role")).alias("role"),
        F.when(F.col("edit.kind") == 1, F.col("text")).otherwise(F.lit("")).alias("text"))
    return audits_of, messages


def hashed(messages: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines.  Rows stream by in
    order; a conversation of any length costs one row of memory."""
    in_order = messages.repartition("conv").sortWithinPartitions("conv", "range", "block", "place", "kind", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            names, hashes = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "role", "text")]
            for c, role, text in zip(*columns):
                if c != conv:
                    if conv is not None:
                        names.append(conv)
                        hashes.append(state.hexdigest())
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hashes, pa.string())], names=["conv", "repaired_sha256"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    return in_order.mapInArrow(run, "conv string, repaired_sha256 string")


def report(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per original conversation: faults, cost, audit and hash."""
    audits, messages = repair(conversations, block_rows)
    turns = damaged(conversations).select("conv", "turn").distinct().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    all_of = conversations.select("conv_id").distinct().withColumn("conv", conversation())
    out = all_of.join(turns, "conv", "left").join(audits, "conv", "left").join(hashed(messages), "conv", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
