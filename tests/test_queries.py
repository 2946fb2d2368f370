"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import registry
from tidemark.plans.views import TABLES

SMALL = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(norm(r[i]) for i in order) for r in values])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
