"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from difflake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    ours = registry.QUERIES[name](spark, SF).toArrow()
    theirs = con.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(ours.column_names)
    assert names == sorted(theirs.column_names)
    rows = lambda t: sorted(repr([plain(r[n]) for n in names]) for r in t.to_pylist())
    assert rows(ours) == rows(theirs)
