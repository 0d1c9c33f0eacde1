"""Study metrics with missing parts, the region lookup, and audit searches."""
import datetime as dt
import itertools

import pytest

from quarry.operators import filters as FL
from quarry.operators import stats as ST


def test_studies_that_other_tables_do_not_know(spark):
    patients = spark.createDataFrame([("s1",), ("s1",), ("s2",)], "study_id string")
    dqi = spark.createDataFrame([("s1", "a", 80.0), ("s1", "a", 90.0), ("s1", "b", 96.0)], "study_id string, site_id string, dqi_score double")
    clean = spark.createDataFrame([("s1", True, False), ("s1", False, False)], "study_id string, tier1_clean boolean, tier2_clean boolean")
    lock = spark.createDataFrame([("s1", True, True), ("s1", False, True), ("s1", False, False)], "study_id string, dblock_tier1_ready boolean, dblock_eligible boolean")
    issues = spark.createDataFrame([("s1", 3), ("s1", 4)], "study_id string, total_issues int")
    got = {r["study_id"]: r for r in ST.study_metrics(patients, dqi, clean, lock, issues).collect()}
    a, b = got["s1"], got["s2"]
    assert (a["patients"], a["sites"], a["worst_site_dqi"], a["low_sites"], a["total_issues"]) == (2, 2, 85.0, 1, 7)
    assert abs(a["mean_dqi"] - 266 / 3) < 1e-9 and (a["tier1_rate"], a["tier2_rate"]) == (50.0, 0.0)
    assert (a["lock_ready"], a["lock_eligible"], a["lock_rate"]) == (1, 2, 50.0)
    assert [b[c] for c in ("patients", "sites", "mean_dqi", "lock_eligible", "lock_rate", "total_issues")] == [1, 0, 0.0, 0, 0.0, 0]


def test_sites_without_a_region_are_unknown(spark):
    sites = spark.createDataFrame([("a", 3, 90.0), ("b", 1, 80.0), ("c", 2, 70.0), ("d", 5, 60.0)], "site_id string, patients int, dqi_mean double")
    lookup = spark.createDataFrame([("a", "EU"), ("a", "ASIA"), ("b", "EU"), ("c", None)], "site_id string, region string")
    got = {r["region"]: (r["sites"], r["patients"], r["mean_of_sites"]) for r in ST.by_region(sites, lookup).collect()}
    assert got == {"ASIA": (1, 3, 90.0), "EU": (1, 1, 80.0), "Unknown": (2, 7, 65.0)}


def test_audit_search_takes_any_criteria(spark):
    day = lambda n: dt.datetime(2024, 1, 1 + n % 9)
    cols = ["entry_id", "timestamp", *FL.AUDIT_EQUAL]
    rows = [(i, day(i), i % 3, "ab"[i % 2], "u", "site", f"e{i % 4}", "low" if i % 5 else "high", i % 2 == 0, f"c{i % 6}") for i in range(60)] + [(7, day(7), 1, "b", "u", "site", "e3", "low", False, "c1")]
    df = spark.createDataFrame(rows, "entry_id int, timestamp timestamp_ntz, actor_id int, event_type string, action_category string, entity_type string, entity_id string, severity string, success boolean, correlation_id string")
    flags = [(i, f) for i in range(60) for f in (("x", "x") if i % 4 == 0 else ("y",))]
    tags = [(i, "t") for i in range(0, 60, 3)]
    fdf, tdf = spark.createDataFrame(flags, "entry_id int, flag string"), spark.createDataFrame(tags, "entry_id int, tag string")
    choices = [{}, {"actor_id": 1}, {"event_type": "a", "success": True}, {"entity_id": "e3", "severity": "low"}, {"correlation_id": "c1"}]
    for equal, start, flag, tag in itertools.product(choices, (None, day(3)), (None, "x"), (None, "t")):
        want = {r for r in rows if all(r[cols.index(c)] == v for c, v in equal.items()) and (start is None or start <= r[1] <= day(6))
                and (flag is None or (r[0], flag) in flags) and (tag is None or (r[0], tag) in tags)}
        got = FL.audit_search(df, fdf, tdf, start=start, end=start and day(6), flag=flag, tag=tag, limit=5, offset=2, **equal).collect()
        assert [tuple(r)[:-1] for r in got] == sorted(want, key=lambda r: (-r[1].toordinal(), r[0]))[2:7]
        assert all(r["total"] == len(want) for r in got)
    with pytest.raises(ValueError):
        FL.audit_search(df, colour="red")
