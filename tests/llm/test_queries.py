"""Queries with SQL equal DuckDB on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from sonolume.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rel = con.sql(queries.SQL[name])
    assert set(rel.columns) <= set(cols)
    at = sorted(rel.columns)
    rows = Counter(tuple(r[c] for c in at) for r in got.collect())
    place = [rel.columns.index(c) for c in at]
    assert rows and rows == Counter(tuple(r[i] for i in place) for r in rel.fetchall())
