"""Conversation repair against plain enumeration of all edits."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from quarry.llm import queries, repair

SF = "/root/testdata/sf0.01"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    """(turn, role, text) of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        conv, said, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv}:{said}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    tie = lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64], hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).hexdigest())
    return sorted(out, key=tie)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found, state=0):
    """Cost, audit and lines from a state, by all places and states backwards."""
    step = lambda s, c: {"0s": 1, "0u": 2, "1u": 2, "2a": 3, "3u": 2}.get(f"{s}{c}")
    far = (1 << 60, "", ())

    def open_up(best):
        for _ in range(4):  # insertions
            for s, c in itertools.product(range(4), "ua"):
                if (t := step(s, c)) is not None and best[t][0] < far[0]:
                    cost, audit, lines = best[t]
                    best[s] = min(best[s], (cost + 2, "I" + audit, ("user:" if c == "u" else "assistant:", *lines)))
        return best

    best = open_up([(0, "", ()), far, far, (0, "", ())])
    for (_, role, text), fault in zip(reversed(rows), reversed(found)):
        now = []
        for s in range(4):
            options = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for label, name in [("K", role), ("R", "user"), ("R", "assistant")]:
                    t = step(s, name[:1])
                    if t is not None:
                        options.append((best[t][0] + more + 2 * (label == "R"), label + best[t][1], (f"{name}:{text}", *best[t][2])))
            now.append(min(options))
        best = open_up(now)
    return best[state]


def everything(rows, found):
    """All edit sequences of a short conversation, at most two insertions to a place."""
    options = []
    for (_, role, text), fault in zip(rows, found):
        may = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            cost = int(fault == "truncated")
            may += [("K", cost, (role, text)), ("R", cost + 2, ("user", text)), ("R", cost + 2, ("assistant", text))]
        options.append(may)
    places = [(), *[(a,) for a in ("user", "assistant")], *itertools.product(("user", "assistant"), repeat=2)]
    least = None
    for gaps in itertools.product(places, repeat=len(rows) + 1):
        for picks in itertools.product(*options):
            cost, audit, lines = 2 * sum(map(len, gaps)) + sum(p[1] for p in picks), "", []
            for i, gap in enumerate(gaps):
                audit += "I" * len(gap)
                lines += [(g, "") for g in gap]
                if i < len(picks):
                    audit += picks[i][0]
                    lines += [picks[i][2]] if picks[i][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                key = (cost, audit, tuple(f"{r}:{t}" for r, t in lines))
                least = min(least, key) if least else key
    return least


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, own in by.items():
        left = damage(own)
        found = faults(left)
        cost, audit, lines = cheapest(left, found)
        turns = {t for t, _, _ in left if t is not None}
        initials = [r[:1] for _, r, _ in left]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def compare(spark, rows, block_rows=repair.BLOCK_ROWS, ddl="conv_id bigint, turn bigint, role string, text string"):
    df = spark.createDataFrame(rows, ddl).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df, block_rows).collect()}
    want = expected([r[:4] for r in rows])
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == w, (k, got[k], w)


def test_backward_costs_equal_full_enumeration():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", " ", "c!", "a."])) for i in range(rng.randrange(0, 4))]
        found = faults(rows)
        want, got = everything(rows, found), cheapest(rows, found)
        assert got == want, (rows, got, want)


def table(seed, conversations=250):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "supervisor"]
    texts = ["Yes.", "No!", "what", "", " \t", None, "a. b", "Yes.", "x" * 70 + ".", "x" * 70 + "!", ".", "é?", "line\nbreak"]
    rows = []
    for c in [None, *range(conversations)]:
        for i in range(rng.randrange(0, 9)):
            turn = None if rng.random() < 0.1 else rng.randrange(6) if rng.random() < 0.3 else i
            rows.append((c, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_random_conversations(spark, block_rows):
    compare(spark, table(block_rows), block_rows)


def test_given_table(spark):
    compare(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    assert queries()["op13_conversation_repair"](spark, SF).count() == 100


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", "ok", f"t{i}.", f"t{i}"])) for i in range(3000)]
    rows += [(7, None, "user", "same")] * 700 + [(c, 0, "user", "hi.") for c in range(100, 160)]
    compare(spark, rows, 100)
    compare(spark, rows)


def test_awkward_tables(spark):
    ddl = "conv_id bigint, turn bigint, role string, text string, conv string, place int, kind int, audit string, range int"
    more = ("c", 1, 2, "K", 3)
    rows = [(c, t, r, x, *more) for c, t, r, x in [(1, None, None, None), (2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "fine."), (3, 5, "user", "a."), (3, 5, "user", "a."),
                                                    (None, None, None, None), (4, -3, "assistant", "b."), (4, 9, "user", "😀 é!")]]
    compare(spark, rows, ddl=ddl)
    assert repair.report(spark.createDataFrame([], ddl)).collect() == []
    dropped = [i for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    compare(spark, [(i, 0, "user", "gone.") for i in dropped])


def test_least_audits_from_every_state():
    """Blocks ranked together give each state's least audit, whatever its length."""
    rng = random.Random(9)
    work, want = [], []
    for _ in range(40):
        rows = [(i, rng.choice(["s", "u", "a", "-"]), f"{i}.") for i in range(rng.randrange(1, 40))]
        found = [rng.choice(["", "", "truncated", "blank"]) for _ in rows]
        work.append(([(r, {"": 0, "truncated": 1, "blank": 2}[f], 1) for (_, r, _), f in zip(rows, found)], repair.AT_END, True))
        want.append([cheapest(rows, found, s)[1] for s in range(4)])
    got = repair.least_audits(work)
    assert [[audit for _, audit in block] for block in got] == want
    assert all(state in (0, 3) for block in got for state, _ in block)
