"""The history queries with the reference's 90 rows a pattern, on tables that reach it."""

from pathlib import Path

import duckdb
import pytest

from punctuo.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "count"), [("history_ring_90", 37_800), ("trimmed_mean_predict_90", 420)])
def test_full_ring(spark, name, count):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = QUERIES[name](spark, DATA)
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    got = sorted(tuple(r[n] for n in names) for r in df.collect())
    assert len(got) == count
    assert got == [pytest.approx(r) for r in sorted(found.fetchall())]
