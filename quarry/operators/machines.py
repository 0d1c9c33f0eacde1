"""State machines over the ordered rows of a key, run by blocks.

A machine reads a key's rows in order of time and id; each row's outcome hangs
on the state that the rows before it left.  Rows are range-partitioned by (key,
time, id) and numbered inside their range, so a key with most of all rows is
spread over many blocks of `BLOCK_ROWS` rows, and no task holds a key.

A block is a function from the state it is entered in to the state it leaves.
Such functions compose, so only they have to be put in sequence, not the rows:

* a machine that can tabulate the function for every state (`table`) does so for
  all blocks at once; the tables of a key, a few numbers for each block, are
  applied one after the other and give each block's entry;
* any other machine runs all blocks from the entries known so far (at first the
  initial state), hands each block's exit to the next, and runs those again
  whose entry has changed, until none has.  A state forgets what is over a day
  old, so blocks soon agree whatever they were entered in.

A last pass gives every row its outcome.  States are lists of integers of
bounded length.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize_table

BLOCK_ROWS = 65_536
HOUR = 3_600_000_000
DAY = 24 * HOUR

State = list[int]


class Machine:
    """`run` gives the outcome of each row and the state left behind; times are
    microseconds in ascending order."""

    initial: State = []
    #: States equal to the initial one once they are this old (None: never).
    forgets: int | None = None

    def run(self, times: np.ndarray, codes: np.ndarray, state: State) -> tuple[list[int], State]:
        raise NotImplementedError


class KeepFirst(Machine):
    """A row is kept (1) if the last kept one is over `window` ago.
    State: the last kept time, or nothing."""

    def __init__(self, window: int):
        self.window = self.forgets = window

    def run(self, times, codes, state):
        out, last = [], state[0] if state else None
        for t in times.tolist():
            keep = last is None or t - last > self.window
            out.append(int(keep))
            last = t if keep else last
        return out, [last]

    def table(self, times: np.ndarray, codes: np.ndarray) -> list[int]:
        """Where the last kept time leads: [times after which the next row is
        kept, ..., their exits, ...], at last unchanged."""
        n, exits = len(times), [0] * len(times)
        after = np.searchsorted(times, times + self.window, "right")
        for i in range(n - 1, -1, -1):  # what is left if row i is kept
            exits[i] = int(times[i]) if after[i] == n else exits[after[i]]
        # from a last kept time o the next kept row is the first behind o + window
        return _runs([int(t) - self.window for t in times], exits)

    def lookup(self, table: list[int], state: State) -> State:
        bounds, exits = table[:len(table) // 2], table[len(table) // 2:]
        if not state:
            return [exits[0]]
        k = int(np.searchsorted(np.array(bounds), state[0], "right"))
        return [exits[k]] if k < len(exits) else state


def _runs(bounds: list[int], exits: list[int]) -> list[int]:
    """Neighbours with one exit put together; the last bound of each stays."""
    keep = [i for i in range(len(exits)) if i + 1 == len(exits) or exits[i] != exits[i + 1]]
    return [bounds[i] for i in keep] + [exits[i] for i in keep]


class Circuit(Machine):
    """Closed until `threshold` failures (code 1) in a row, then open; from
    `reset` after it opened the next row decides: a failure opens it again, any
    other closes it.  Outcome 1: open behind the row.  State: [0, failures] or
    [1, time it opened]."""

    initial = [0, 0]

    def __init__(self, threshold: int = 3, reset: int = HOUR):
        self.threshold, self.reset = threshold, reset

    def run(self, times, codes, state):
        out, (status, value) = [], state
        for t, bad in zip(times.tolist(), codes.tolist()):
            if status and t - value >= self.reset:
                status, value = (1, t) if bad else (0, 0)
            elif not status:
                value = value + 1 if bad else 0
                if value >= self.threshold:
                    status, value = 1, t
            out.append(status)
        return out, [status, value]

    def table(self, times: np.ndarray, codes: np.ndarray) -> list[int]:
        """Exits for 0 .. threshold - 1 failures, then bounds and exits for the
        time it opened; an exit is two numbers."""
        n, k = len(times), self.threshold
        ready = np.searchsorted(times, times + self.reset, "left")
        opened: list[State] = [[]] * (n + 1)  # what is left if it opens at row i
        closed: list[list[State]] = [[]] * (n + 1)  # if it is closed behind row i - 1, by failures
        closed[n] = [[0, f] for f in range(k)]
        decided: list[State] = [[]] * n  # if row i decides
        for i in range(n - 1, -1, -1):
            bad, j = bool(codes[i]), int(ready[i])
            opened[i] = [1, int(times[i])] if j == n else decided[j]
            decided[i] = opened[i] if bad else closed[i + 1][0]
            closed[i] = [(opened[i] if f + 1 >= k else closed[i + 1][f + 1]) if bad else closed[i + 1][0] for f in range(k)]
        flat = [x for s in closed[0] for x in s]
        keep = [i for i in range(n) if i + 1 == n or decided[i] != decided[i + 1]]
        return flat + [int(times[i]) - self.reset for i in keep] + [x for i in keep for x in decided[i]]

    def lookup(self, table: list[int], state: State) -> State:
        flat = 2 * self.threshold
        if not state[0]:
            return list(table[2 * state[1]:2 * state[1] + 2])
        n = (len(table) - flat) // 3
        k = int(np.searchsorted(np.array(table[flat:flat + n]), state[1], "left"))
        return list(table[flat + n + 2 * k:flat + n + 2 * k + 2]) if k < n else state


class Fatigue(Machine):
    """A row is held back (1) if `per_hour` let through lie in the hour or
    `per_day` in the day before it, exempt ones (code 1) included; those are
    never held back.  State: the latest times let through, as many as count."""

    def __init__(self, per_hour: int, per_day: int):
        self.per_hour, self.per_day, self.forgets = per_hour, per_day, DAY

    def run(self, times, codes, state):
        out, sent, most = [], list(state), max(self.per_hour, self.per_day)
        for t, exempt in zip(times.tolist(), codes.tolist()):
            many = (len(sent) >= self.per_hour and sent[-self.per_hour] >= t - HOUR) or (len(sent) >= self.per_day and sent[-self.per_day] >= t - DAY)
            if many and not exempt:
                out.append(1)
            else:
                out.append(0)
                sent.append(t)
                if len(sent) > 4 * most:
                    sent = sent[-most:]
        return out, [t for t in sent[-most:] if not len(times) or t >= times[-1] - DAY]


def micros(ts: str) -> Column:
    """Microseconds of a timestamp, as its clock shows it."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def _blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows with the number of their range and block, written once."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array((at // block_rows).astype(np.int32))], names=[*batch.schema.names, "_p", "_b"])

    ordered = rows.repartitionByRange("key", "us", "id").sortWithinPartitions("key", "us", "id")
    return materialize_table(ordered.mapInArrow(number, "key string, us bigint, id bigint, code int, _p int, _b int"), "machine-rows")


def _keys(part: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    part = part.sort_values(["key", "us", "id"], kind="stable")
    yield from part.groupby("key", sort=False)


def clock(us: str) -> Column:
    """The timestamp that `micros` was made from."""
    return F.expr(f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


BLOCK = ["_p", "_b"]
ENTRY = "key string, _p int, _b int, state array<bigint>"


def _list(x) -> State:
    return [] if x is None else [int(v) for v in x]


def _tabulated(x: DataFrame, machine: Machine, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of all blocks and exits of all keys, from the blocks' tables."""
    def tables(part: pd.DataFrame) -> pd.DataFrame:
        out = [(key, int(own["_p"].iloc[0]), int(own["_b"].iloc[0]), machine.table(own["us"].to_numpy(), own["code"].to_numpy())) for key, own in _keys(part)]
        return pd.DataFrame(out, columns=["key", "_p", "_b", "table"])

    found = x.groupBy(*BLOCK).applyInPandas(tables, "key string, _p int, _b int, table array<bigint>")
    by_key = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_p", "_b", "table"))).alias("blocks")).join(given, "key", "left")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, blocks, state in zip(part["key"], part["blocks"], part["state"]):
                state, entries = machine.initial if state is None else _list(state), []
                for b in blocks:
                    entries.append({"_p": b["_p"], "_b": b["_b"], "state": state})
                    state = machine.lookup(_list(b["table"]), state)
                out.append((key, entries, state))
            yield pd.DataFrame(out, columns=["key", "entries", "state"])

    folded = materialize_table(by_key.mapInPandas(fold, "key string, entries array<struct<_p:int,_b:int,state:array<bigint>>>, state array<bigint>"), "machine-fold")
    entries = folded.select("key", F.explode("entries").alias("e")).select("key", "e._p", "e._b", "e.state")
    return entries, folded.select("key", "state")


def _settled(x: DataFrame, machine: Machine, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same by running blocks until their entries stay."""
    def run(part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        states, out = dict(zip(entry["key"], entry["state"])), []
        for key, own in _keys(part):
            if key in states:
                _, left = machine.run(own["us"].to_numpy(), own["code"].to_numpy(), _list(states[key]))
                out.append((key, int(own["_p"].iloc[0]), int(own["_b"].iloc[0]), left))
        return pd.DataFrame(out, columns=["key", "_p", "_b", "exit"])

    start = F.array(*[F.lit(v).cast("bigint") for v in machine.initial]) if machine.initial else F.expr("CAST(array() AS array<bigint>)")
    order = Window.partitionBy("key").orderBy(*BLOCK)
    first = x.select("key", *BLOCK).distinct().withColumn("_n", F.row_number().over(order)).join(given, "key", "left")
    entries = materialize_table(first.select("key", *BLOCK, F.when(F.col("_n") == 1, F.coalesce("state", start)).otherwise(start).alias("state"), (F.col("_n") == 1).alias("first")), "machine-entries")
    todo, exits = entries, None
    while True:
        ran = x.groupBy(*BLOCK).cogroup(todo.groupBy(*BLOCK)).applyInPandas(run, "key string, _p int, _b int, exit array<bigint>")
        if exits is not None:  # blocks that did not run again keep their exit
            ran = ran.unionByName(exits.join(ran.select("key", *BLOCK), ["key", *BLOCK], "left_anti"))
        exits = materialize_table(ran, "machine-exits")
        after = exits.withColumn("next", F.lag("exit").over(order)).select("key", *BLOCK, "next")
        checked = entries.join(after, ["key", *BLOCK]).withColumn("new", F.when(F.col("first"), F.col("state")).otherwise(F.col("next")))
        checked = materialize_table(checked.select("key", *BLOCK, F.col("new").alias("state"), "first", (F.col("new") != F.col("state")).alias("changed")), "machine-entries")
        entries, todo = checked.drop("changed"), checked.where("changed").drop("changed")
        if todo.isEmpty():
            break
    last = exits.groupBy("key").agg(F.max_by("exit", F.struct(*BLOCK)).alias("state"))
    return entries.select("key", *BLOCK, "state"), last


def outcomes(rows: DataFrame, machine: Machine, given: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """((key, us, id, outcome) of all rows, (key, state) behind the last row of each
    key) for rows (key string, us bigint, id bigint, code int); `given` holds
    the states (key, state) that keys begin in.  Ids are distinct; a null key is
    a key."""
    spark = rows.sparkSession
    rows = rows.select(F.coalesce(F.col("key"), F.lit("\x00null")).alias("key"), F.col("us").cast("bigint").alias("us"), F.col("id").cast("bigint").alias("id"), F.col("code").cast("int").alias("code"))
    given = spark.createDataFrame([], "key string, state array<bigint>") if given is None else given
    x = _blocked(rows, block_rows)
    entries, exits = (_tabulated if hasattr(machine, "table") else _settled)(x, machine, given)

    def run(part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        states = dict(zip(entry["key"], entry["state"]))
        out = [pd.DataFrame({"key": key, "us": own["us"], "id": own["id"], "outcome": machine.run(own["us"].to_numpy(), own["code"].to_numpy(), _list(states[key]))[0]}) for key, own in _keys(part)]
        return pd.concat(out) if out else pd.DataFrame({"key": [], "us": [], "id": [], "outcome": []})

    flags = x.groupBy(*BLOCK).cogroup(entries.groupBy(*BLOCK)).applyInPandas(run, "key string, us bigint, id bigint, outcome int")
    null = F.when(F.col("key") != "\x00null", F.col("key"))
    return flags.withColumn("key", null), exits
