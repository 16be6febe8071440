"""Queries of the training-data operators against their SQL on the smallest tables."""

import duckdb
import pytest

from difflake.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF).toArrow(), con.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(ours.column_names)
    assert names == sorted(theirs.column_names)
    rows = lambda t: sorted(repr([r[n] for n in names]) for r in t.to_pylist())
    assert rows(ours) == rows(theirs)
