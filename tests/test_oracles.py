"""Every registered retrieval query that has SQL, against DuckDB at the smallest size."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verbatrix import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in names) for r in got.collect())
    found = duck.execute(queries.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in names]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_too_large_to_be_dealt(spark, monkeypatch):
    want = Counter(map(tuple, queries.table(spark, SF, "documents", "doc_id", "source").collect()))
    monkeypatch.setattr(queries, "SPREAD_BYTES", 0)
    df = queries.table(spark, SF, "documents", "doc_id", "source")
    assert Counter(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() == 1
