"""Every query with an oracle gives the oracle's rows."""

import datetime
from pathlib import Path

import duckdb
import pytest

from punctuo.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def shown(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([shown(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())
