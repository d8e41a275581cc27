"""Every registered query against its SQL counterpart on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert compare(rows, df.columns, cur.fetchall(), cols, edges=True) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
