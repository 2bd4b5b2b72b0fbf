"""Every query with SQL returns the rows that DuckDB does."""

import math
from pathlib import Path

import duckdb
import pytest

from polis.registry import FLAGSHIP, QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
    assert got == want


def test_flagship_is_a_query():
    assert FLAGSHIP in QUERIES
