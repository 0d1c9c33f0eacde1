"""Machines run by blocks against row-by-row loops."""
import random
from collections import defaultdict

import numpy as np
import pytest

from quarry.operators import machines as MC

MINUTE = 60_000_000


def loop(machine, rows):
    """Every key by itself, row after row."""
    out, left, by = {}, {}, defaultdict(list)
    for key, us, i, code in rows:
        by[key].append((us, i, code))
    for key, own in by.items():
        own.sort()
        found, state = machine.run(np.array([r[0] for r in own]), np.array([r[2] for r in own]), list(machine.initial))
        out |= {i: o for (_, i, _), o in zip(own, found)}
        left[key] = state
    return out, left


def plain_circuit(rows, threshold, reset):
    """The circuit as told: closed, open, half open."""
    out, by = {}, defaultdict(list)
    for key, us, i, code in rows:
        by[key].append((us, i, code))
    for own in by.values():
        status, failures, opened = "closed", 0, 0
        for us, i, bad in sorted(own):
            if status == "open" and us - opened >= reset:
                status = "half_open"
            if bad:
                if status == "half_open":
                    status, opened = "open", us
                else:
                    failures += 1
                    if failures >= threshold and status == "closed":
                        status, opened = "open", us
            elif status == "half_open":
                status, failures = "closed", 0
            elif status == "closed":
                failures = 0
            out[i] = int(status == "open")
    return out


def table(seed, n=4000):
    """Nine tenths of the rows have one key; times repeat and leave gaps."""
    rng = random.Random(seed)
    rows, us = [], 0
    for i in range(n):
        us += rng.choice([0, 1, 5, 20, 70, 3000 if rng.random() < 0.02 else 2]) * MINUTE
        rows.append(("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), us, i, int(rng.random() < 0.6)))
    return rows


MACHINES = {"keep": MC.KeepFirst(60 * MINUTE), "circuit": MC.Circuit(3, 60 * MINUTE), "fatigue": MC.Fatigue(5, 12)}


@pytest.mark.parametrize("name", MACHINES)
@pytest.mark.parametrize("block", [7, 300])
def test_blocks_equal_the_loop(spark, name, block):
    rows, machine = table(block), MACHINES[name]
    df = spark.createDataFrame(rows, "key string, us bigint, id bigint, code int").repartition(6)
    flags, exits = MC.outcomes(df, machine, block_rows=block)
    want, left = loop(machine, rows)
    assert {r["id"]: r["outcome"] for r in flags.collect()} == want
    assert {r["key"]: list(r["state"]) for r in exits.collect()} == {k or "\x00null": s for k, s in left.items()}
    if name == "circuit":
        assert want == plain_circuit(rows, 3, 60 * MINUTE) and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("name", ["keep", "circuit"])
def test_tables_equal_runs_from_every_state(name):
    rng, machine = random.Random(1), MACHINES[name]
    for _ in range(200):
        n = rng.randrange(1, 30)
        times = np.cumsum([rng.choice([0, 10, 40, 60, 100]) * MINUTE for _ in range(n)]) + 10 ** 12
        codes = np.array([int(rng.random() < 0.5) for _ in range(n)])
        told = machine.table(times, codes)
        starts = [int(times[0]) - rng.randrange(0, 200) * MINUTE for _ in range(20)]
        states = [[], *[[s] for s in starts]] if name == "keep" else [[0, 0], [0, 1], [0, 2], *[[1, s] for s in starts]]
        for state in states:
            assert machine.lookup(told, list(state)) == machine.run(times, codes, list(state))[1]


def test_halves_give_what_the_whole_gives(spark):
    """Exits of the first half are the entries of the second, as between triggers of a stream."""
    for machine in MACHINES.values():
        rows = table(11, 1500)
        ddl = "key string, us bigint, id bigint, code int"
        one, left = MC.outcomes(spark.createDataFrame(rows[:700], ddl), machine, block_rows=50)
        two, _ = MC.outcomes(spark.createDataFrame(rows[700:], ddl), machine, left, block_rows=50)
        assert {r["id"]: r["outcome"] for r in one.unionByName(two).collect()} == loop(machine, rows)[0]


def test_no_rows(spark):
    for machine in MACHINES.values():
        flags, exits = MC.outcomes(spark.createDataFrame([], "key string, us bigint, id bigint, code int"), machine)
        assert flags.collect() == exits.collect() == []


def test_a_stream_of_several_triggers_equals_the_loop(spark, tmp_path):
    """One file a trigger, in order of time: states are carried from one to the next."""
    from quarry.streaming import alerts_stream as ST

    rows = sorted(table(21, 900), key=lambda r: (r[1], r[2]))
    ddl = "key string, us bigint, id bigint, code int"
    for k in range(5):
        spark.createDataFrame(rows[k * 180:(k + 1) * 180], ddl).coalesce(1).write.parquet(str(tmp_path / "rows" / f"part={k}"))
    for name, machine in MACHINES.items():
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows")).select("key", "us", "id", "code")
        got = {r["id"]: r["outcome"] for r in ST.run_machine(stream, machine, f"test-{name}").collect()}
        assert got == loop(machine, rows)[0], name
