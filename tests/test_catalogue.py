"""Every query with SQL equals DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from sonolume.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = sorted((tuple(normal(r[c]) for c in cols) for r in got.collect()), key=repr)
    assert rows
    if name not in catalogue.SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted((tuple(normal(r[i]) for i in at) for r in rel.fetchall()), key=repr)
