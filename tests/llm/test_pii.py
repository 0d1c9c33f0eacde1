"""Personal data against plain Python with the base patterns as given."""
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from quarry.llm import pii, queries
from tests.llm.conftest import ROWS

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, m):
    digits = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if passes(k, m[0])]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    n = 0
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        r = got[i]
        mine = [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE]
        assert ",".join(mine) == joined, (t, mine, joined)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in BASE] == [sum(w[0] == k for w in want) for k, _ in BASE]
        n += len(want)
    return n


def test_base_kinds_on_random_texts(spark):
    rng = random.Random(7)
    parts = ["@", ".", "-", " ", "  ", "a", "b.c", "x_", "%", "+", "+1", "1", "12", "255", "256", "007", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1111",
             "555-7713", "a@b.c", "1.2.3.4", "\n", "é", "😀", "mail", "0", "000", "9" * 15, "4222222222222"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    assert check(spark, texts) > 1500


def test_tables_and_awkward_rows(spark, awkward, nothing):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert check(spark, docs) > 20
    check(spark, [t for _, t in ROWS])
    assert pii.digest(awkward).count() == len(ROWS) and pii.digest(nothing).collect() == []
    kept = pii.with_spans(awkward)
    assert kept.columns == [*awkward.columns, "pii"] and kept.count() == len(ROWS)
    again = pii.with_spans(kept.withColumn("_pii_email", F.lit(1)).drop("_pii_email"))
    assert again.columns == kept.columns


def test_long_texts_take_time_by_their_length(spark):
    """Runs that naive patterns rescan or recurse into, and very many matches."""
    long = ["a" * 200_000, "a." * 100_000 + "@", "x@" + "a." * 100_000 + "a", "1 " * 200_000, "1." * 100_000, "+1" + " (" * 100_000, "1-" * 100_000,
            "0" * 200_000 + ".1.1.1", "AB12" * 50_000, "DE89 " * 40_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    t = time.time()
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    assert time.time() - t < 60
    assert [got[2][c] for c in ("n_email", "n_ip")] == [1, 0] and got[4]["n_ip"] == 25_000
    assert got[4]["spans"].startswith("ip:0:7,ip:8:15,ip:16:23") and got[4]["spans"].endswith("ip:199992:199999")
    many = "a@b.c " * 20_000
    assert check(spark, [many, "1.1.1.1 " * 1500]) == 21_500


def iban(country, rest):
    turned = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{country}{98 - int(turned) % 97:02d}{rest}"


def kinds_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = pii.with_spans(df).orderBy("doc_id").collect()
    return [[(s["kind"], r["text"][s["start"]:s["end"]], s["score"]) for s in r["pii"] if s["kind"] not in pii.BASE] for r in rows]


def test_added_kinds_need_their_checksum_and_context(spark):
    good = iban("DE", "370400440532013000")
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    spaced = " ".join(good[i:i + 4] for i in range(0, len(good), 4))
    nhs = next(f"943476{i:04d}" for i in range(9999) if sum(int(c) * (10 - k) for k, c in enumerate(f"943476{i:04d}")) % 11 == 0)
    texts = [f"pay to {good} now", f"pay to {bad} now", f"{spaced} IBAN OF US", "SSN 123-45-6789", "part 123-45-6789", "SSN 666-45-6789", f"NHS number {nhs}", f"lot {nhs}",
             "routing 021000021", "routing 021000022", "born 31.02.1980", "geboren am 28.02.1980", "on 28.02.1980", "call (555) 123-4567", "order 555 123 4567",
             "example SSN 123-45-6789", "né le 1980-02-28"]
    got = kinds_of(spark, texts)
    only = [[(k, t) for k, t, _ in g] for g in got]
    assert only[0] == [("iban", good)] and only[1] == [] and only[2] == [("iban", spaced)]
    assert only[3] == [("ssn", "123-45-6789")] and only[4] == only[5] == []
    assert only[6] == [("health", nhs)] and only[7] == []
    assert only[8] == [("routing", "021000021")] and only[9] == []
    assert only[10] == [] and only[11] == [("birth", "28.02.1980")] and only[12] == [] and only[16] == [("birth", "1980-02-28")]
    assert only[13] == [("local_phone", "(555) 123-4567")] and only[14] == [] and only[15] == []
    assert got[0][0][2] < got[2][0][2]  # a word that names it raises the score


def test_context_ends_at_the_neighbouring_match(spark):
    got = kinds_of(spark, ["SSN 123-45-6789 then 123-45-6780", "123-45-6789 " + "x " * 30 + " SSN"])
    assert [t for _, t, _ in got[0]] == ["123-45-6789"] and got[1] == []


def test_plan_has_no_python(spark):
    plan = pii.digest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert queries()["op11_pii_spans"](spark, "/root/testdata/sf0.001").count() == 200
