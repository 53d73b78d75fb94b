"""Corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from pairvox.llm import queries

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    got = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = [df.columns.index(c) for c in columns]
    rows = [tuple(r[i] for i in order) for r in df.collect()]
    assert sorted(rows, key=str) == sorted(got.fetchall(), key=str) and rows
