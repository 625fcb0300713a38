"""Queries of the subpackage that have SQL, against DuckDB over whole tables at the smallest scale."""

import os

import pytest

from veriloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, SF), connection.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in wanted.description)
    assert sorted(found.columns) == names
    place = {d[0]: i for i, d in enumerate(wanted.description)}
    want = sorted((tuple(r[place[n]] for n in names) for r in wanted.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == want
