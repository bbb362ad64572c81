"""Each query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from lumetrica import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(path := f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.8g}" if isinstance(v, float) else str(v)

    return [names[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    df = core.QUERIES[name](spark, sf_dir)
    found = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(core.ORACLE_SQL[name])
    wanted = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0
