"""Queries of the llm subpackage that have SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from lumetrica.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
