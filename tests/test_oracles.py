"""Every registered query with SQL against it, value by value as the driver compares them."""

import datetime
import decimal
import math

import duckdb
import pytest

from tributary.plans.queries import ORACLES, QUERIES

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def canon(names, values):
    """Rows with columns by name; numbers as doubles of twelve significant digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
            return f"{float(v) + 0.0:.12g}"
        return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canon(names, cur.fetchall())
