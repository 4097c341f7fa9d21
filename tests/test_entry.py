"""Driver contract: entry, every registered query vs its DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tambo.registry import queries as library_queries

from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry(spark):
    df = entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10 and df.columns == ["producto", "precio_promedio", "ranking"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_library_query_is_registered_with_an_oracle():
    assert set(library_queries()) <= set(queries())
    assert set(library_queries()) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(library_queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = {c: i for i, c in enumerate(rel.columns)}
    drows = sorted((tuple(_norm(r[idx[c]]) for c in cols) for r in rel.fetchall()), key=repr)
    assert srows == drows
