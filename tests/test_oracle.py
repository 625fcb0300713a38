"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import os

import pytest

import __spark_entry__
from veriloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, wanted.fetchall())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_a_stratified_sample_has_one_row_a_brand(spark):
    rows = QUERIES["stratified_sample"](spark, SF).collect()
    assert 0 < len(rows) <= 20 and len({r["p_brand"] for r in rows}) == len(rows)
