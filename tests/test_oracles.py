"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{float(x):.6g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert found or name in ORACLES
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert found == _rows(rel.columns, rel.fetchall())
