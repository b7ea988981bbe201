"""Every registered engine query against its SQL oracle on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "events", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def values(rows, columns):
    def cell(v):
        return str(round(float(v), 8)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


def names():
    from millrace.plans import oracles
    return sorted(oracles.ORACLES)


@pytest.mark.parametrize("name", names())
def test_against_oracle(spark, duck, name):
    from millrace.plans import catalogue, oracles
    got = catalogue.QUERIES[name](spark, SF)
    cursor = duck.execute(oracles.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(columns)
    assert values(got.collect(), sorted(columns)) == values(want, sorted(columns))


def test_entry():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
