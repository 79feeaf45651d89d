"""Statistics of training rows over 7 and 14 days, against brute force."""

import datetime as dt
import math
import statistics

import pytest

from punctuo.operators import links as L

OBS = "obs_id long, uid string, weekday int, origin_crs string, departure_hour int, delay_mins int, recorded_at timestamp"
#: Days and hours such that some rows have only the long window, some both, some neither; one is at the edge of 7 days.
TIMES = [(1, 9), (2, 9), (9, 9), (9, 10), (13, 8), (13, 23), (20, 8), (27, 8), (28, 1)]


def test_both_windows_against_brute_force(spark):
    rows = [(i, "A", 0, "LDS", 9, (7 * i) % 5 - 2, dt.datetime(2026, 6, d, h)) for i, (d, h) in enumerate(TIMES)]
    got = {r["obs_id"]: r for r in L.rolling_training(spark.createDataFrame(rows, OBS), ["uid"], 7).collect()}
    seen_alone = 0
    for i, *_, at in rows:
        day = dt.datetime(at.year, at.month, at.day)
        week, two = ([b[5] for b in rows if at - dt.timedelta(days=n) <= b[6] < day] for n in (7, 14))
        seen_alone += bool(two and not week)
        want = dict(
            n=len(week), mean=statistics.fmean(week) if week else 0, std=statistics.pstdev(week) if week else 0, log_n=math.log1p(len(week)),
            on_time=100 * sum(d <= 0 for d in week) / len(week) if week else 0, mean_14=statistics.fmean(two) if two else 0, std_14=statistics.pstdev(two) if two else 0,
        )
        assert {k: got[i][k] for k in want} == pytest.approx(want)
    assert seen_alone
