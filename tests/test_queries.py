"""Registered queries against their SQL on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def _cell(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5) + 0.0
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()[:19]
    return x


def _rows(rows, columns):
    return sorted((tuple(_cell(r[c]) for c in columns) for r in rows), key=repr)


def _names():
    from panelyard.queries import SQL

    return sorted(SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, con, name):
    from panelyard.queries import QUERIES, SQL

    df = QUERIES[name](spark, str(DATA))
    found = con.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert _rows([r.asDict() for r in df.collect()], columns) == _rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 4
    assert {r["series"]: round(r["t"], 3) for r in df.collect()}["spread_l_s2"] < -2.87
