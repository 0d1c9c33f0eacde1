"""Every registered query against its SQL twin on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as E
from quarry.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.oracle_check import _family, rows_hash

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) > 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    if name not in SQL:
        assert rows and len(sdf.columns) > 1  # their values are tested with their operators
        return
    rel = con.sql(SQL[name])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    st = {f.name: _family(f.dataType.simpleString()) for f in sdf.schema.fields}
    dt_ = {c: _family(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert st == dt_
    assert len(rows) == len(drows)
    assert rows_hash(sdf.columns, rows)[0] == rows_hash(rel.columns, drows)[0]
