"""Every registered query that has a DuckDB form gives the same rows in both engines."""

import glob
import math
import os

import duckdb
import pytest

from fidelis.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = duck.execute(SQL[name])
    there = [x[0] for x in got.description]
    assert sorted(there) == names
    assert normal(df.select(*names).collect()) == normal([tuple(r[there.index(n)] for n in names) for r in got.fetchall()])


def test_every_check_is_in_the_catalog_once():
    ids = [c.id for c in catalog.CHECKS]
    assert len(ids) == len(set(ids)) == 38
