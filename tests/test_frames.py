"""Sums over sliding times: equal to brute force, and no frame is added up anew for every row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from punctuo.operators import links as L
from punctuo.operators import models as M

OBS = "obs_id long, uid string, weekday int, origin_crs string, departure_hour int, delay_mins int, recorded_at timestamp"


def drawn(n=400, seed=3):
    r = random.Random(seed)
    start = dt.datetime(2026, 6, 8)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(days=r.randrange(20), minutes=r.randrange(0, 240, 5))
        rows.append((i, r.choice("AB"), at.weekday(), "LDS", 9, r.choice([None, -3, 0, 4, 40]), at))
    return rows


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(drawn(), OBS)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_frame_slides(spark, obs):
    weather = spark.createDataFrame([], "hour timestamp, wind int")
    for df in (L.rolling_training(obs, ["uid"], 7), L.asof_preceding(obs), L.station_congestion(obs), M.engineered(obs, weather, ["uid"])):
        assert "specifiedwindowframe(rangeframe, -" not in plan(df)


def test_rolling_training_against_brute_force(obs):
    got = {r["obs_id"]: r for r in L.rolling_training(obs, ["uid"], 7).collect()}
    rows = drawn()
    assert len(got) == len(rows)
    for i, uid, *_, at in rows:
        day = dt.datetime(at.year, at.month, at.day)
        seen = [b for b in rows if b[1] == uid and at - dt.timedelta(days=7) <= b[6] < day]
        total = sum(b[5] or 0 for b in seen)
        assert got[i]["n"] == len(seen)
        assert got[i]["mean"] == pytest.approx(total / len(seen) if seen else 0)


def test_looks_back_against_brute_force(obs):
    near = {r["obs_id"]: r["congestion"] for r in L.station_congestion(obs).collect()}
    last = {r["obs_id"]: r["preceding_delay"] for r in L.asof_preceding(obs).collect()}
    rows = drawn()
    assert len(near) == len(last) == len(rows)
    for i, uid, *_, at in rows:
        before = lambda m: [b for b in rows if at - dt.timedelta(minutes=m) <= b[6] < at]  # noqa: B023, E731
        known = [b[5] for b in before(30) if b[5] is not None]
        assert near[i] == pytest.approx(sum(known) / len(known) if known else 0)
        newest = max(before(20), key=lambda b: (b[6], b[0]), default=None)
        assert last[i] == (newest[5] if newest and newest[1] != uid else 0)


def test_rows_without_a_time_or_of_equal_ids_stay(spark):
    rows = [(1, "A", 0, "LDS", 9, 5, None), (1, "A", 0, "LDS", 9, 6, dt.datetime(2026, 6, 8, 8)), (1, "A", 0, "LDS", 9, 6, dt.datetime(2026, 6, 9, 8))]
    found = L.rolling_training(spark.createDataFrame(rows, OBS), ["uid"], 7)
    assert sorted((r["n"], r["mean"]) for r in found.filter(F.col("n") > 0).collect()) == [(1, 6.0)]
    assert found.count() == 3


def test_no_row_is_copied_to_ask_for_its_sums(spark, obs):
    weather = spark.createDataFrame([], "hour timestamp, wind int")
    assert "generate" not in plan(L.rolling_training(obs, ["uid"], 7))
    assert plan(M.engineered(obs, weather, ["uid"])).count("generate") == 1  # the two slots of a row
