"""Features never see what they must not, encodings come from the fit dates, models beat the plain rules where there is a signal."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from punctuo.operators import boards as B
from punctuo.operators import models as M

OBS = "obs_id long, uid string, weekday int, origin_crs string, departure_hour int, delay_mins int, recorded_at timestamp"
WEATHER = "hour timestamp, wind int"


def stamp(day, hour, minute=0):
    return dt.datetime(2026, 6, 8) + dt.timedelta(days=day, hours=hour, minutes=minute)


def weekly():
    """Three weekly runs of one train, three readings each, and of another at the same station."""
    rows = []
    for week in range(3):
        for k, delay in enumerate((2 + week, 5 + week, 9 + week)):
            rows.append((len(rows), "C10001", 0, "LDS", 9, delay, stamp(7 * week, 8, 10 * k)))
            rows.append((len(rows), "G20002", 0, "LDS", 9, 1, stamp(7 * week, 8, 10 * k + 3)))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    weather = spark.createDataFrame([(stamp(7, 8), 36), (stamp(14, 8), None)], WEATHER)
    return M.engineered(spark.createDataFrame(weekly(), OBS), weather).cache()


def mine(found, uid="C10001"):
    return found.filter(F.col("uid") == uid).orderBy("recorded_at").collect()


def test_label_is_the_last_reading_of_the_run(found):
    first = mine(found)[:3]
    assert [r["final_delay_mins"] for r in first] == [9, 9, 9]
    assert [r["is_journey_final"] for r in first] == [False, False, True]
    assert [r["current_delay_mins"] for r in first] == [2, 5, 9]


def test_rolling_features_leave_out_the_own_run(found):
    rows = mine(found)
    assert [r["rolling_mean_7d"] for r in rows[:3]] == [0, 0, 0]
    assert [round(r["rolling_mean_7d"], 4) for r in rows[3:6]] == [5.3333, 7, 9]
    assert rows[3]["rolling_std_7d"] == pytest.approx((((2 - 16 / 3) ** 2 + (5 - 16 / 3) ** 2 + (9 - 16 / 3) ** 2) / 3) ** 0.5)
    assert [round(r["rolling_mean_14d"], 4) for r in rows[6:]] == [round((2 + 5 + 9 + 3 + 6 + 10) / 6, 4), round((5 + 9 + 3 + 6 + 10) / 5, 4), round((9 + 3 + 6 + 10) / 4, 4)]


def test_other_trains_and_weather(found):
    rows = mine(found)
    assert [r["preceding_delay_mins"] for r in rows[:3]] == [0, 1, 1]
    assert [r["station_congestion_30m"] for r in rows[:3]] == [0, 1.5, 2.25]
    assert [r["operator_cascade_delay"] for r in rows] == [0] * 9
    assert [(r["wind_mph"], r["volatility_score"]) for r in (rows[0], rows[3], rows[6])] == [(0, 0), (36, 2), (0, 0)]
    assert [r["mins_until_departure"] for r in rows[:3]] == pytest.approx([60, 50, 40])
    assert {r["is_peak"] for r in rows} == {0}


def test_encodings_come_from_the_fit_dates(spark, found):
    codes = M.fit_encodings(found)
    later = found.withColumn("origin_crs", F.when(F.col("obs_id") == 0, "ZZZ").otherwise(F.col("origin_crs")))
    rows = {r["obs_id"]: r for r in M.apply_encodings(later.filter("obs_id < 2"), codes).collect()}
    assert [(rows[i]["origin_crs_enc"], rows[i]["uid_prefix_enc"], rows[i]["weekday_operator_enc"]) for i in (0, 1)] == [(0, 1, 1), (1, 2, 2)]
    assert rows[0]["operator_relative_delay"] == pytest.approx(-sum(r["rolling_mean_7d"] for r in mine(found)) / 9)


def test_split_is_by_date(found):
    parts = {(r["part"], r["service_date"].day) for r in M.split_dates(found, 0.34, 0.2).select("part", "service_date").distinct().collect()}
    assert parts == {("fit", 8), ("validation", 15), ("test", 22)}


def test_augmented_rows_are_seeded_and_weighted(spark):
    fit = spark.createDataFrame([(1, 0.5), (2, 0.5)], "obs_id long, weight double")
    pool = spark.createDataFrame([(i, 2.0) for i in range(100, 200)], "obs_id long, weight double")
    a, b = (sorted(map(tuple, M.augmented(fit, pool.repartition(n), 10, 0.25).collect())) for n in (1, 7))
    assert a == b and len(a) == 12 and {w for _, w, s in a if s} == {0.5}


def signal(spark):
    """Delays that follow the origin and hour, and readings that near the last one of their run; the pattern itself is new each time."""
    rng, rows = random.Random(2), []
    for day in range(24):
        for train in range(25):
            origin, hour = rng.choice("ABCDE"), rng.randrange(6, 22)
            final = 4 * "ABCDE".index(origin) + (12 if hour in (8, 17) else 0) + rng.randrange(3)
            for k in range(3):
                rows.append((len(rows), f"C{rng.randrange(10**5):05}", stamp(day, 0).weekday(), f"ST{origin}", hour, final if k == 2 else final // 2 + k, stamp(day, hour - 1, 15 * k + train % 10)))
                rows[-1] = (*rows[-1][:1], f"C{day:02}{train:03}", *rows[-1][2:])
    return spark.createDataFrame(rows, OBS)


def test_models_beat_the_plain_rules(spark):
    obs = signal(spark)
    parts = M.split_dates(M.engineered(obs, spark.createDataFrame([], WEATHER))).cache()
    fit, held, test = (parts.filter(F.col("part") == p) for p in ("fit", "validation", "test"))
    codes = M.fit_encodings(fit)
    fit, held, test = (M.apply_encodings(p, codes).cache() for p in (fit, held, test))
    day = M.train(fit, held, M.DAY_AHEAD, "delay_mins", trees=20, loss="squared")
    error = M.measured(day.transform(M.vectors(test)), "prediction", "delay_mins").first()["mae"]
    plain = M.measured(B.with_baseline(test, fit.unionByName(held), M.PATTERN), "baseline", "delay_mins").first()["mae"]
    assert error < 0.75 * plain
    names = [n for _, n, _ in M.importances(day, M.DAY_AHEAD)]
    assert {names[0], names[1]} <= {"origin_crs_enc", "departure_hour", "is_peak", "rolling_mean_7d"} and len(names) == 14
    open_runs = [p.filter("not is_journey_final") for p in (fit, held, test)]
    run = M.train(M.tiered(open_runs[0], "final_delay_mins"), open_runs[1], M.REALTIME, "final_delay_mins", trees=20, loss="squared")
    error = M.measured(run.transform(M.vectors(open_runs[2], M.REALTIME)), "prediction", "final_delay_mins").first()["mae"]
    plain = M.measured(open_runs[2], "current_delay_mins", "final_delay_mins").first()["mae"]
    assert error < 0.75 * plain
    # The cascade: a live reading goes to the second model, none to the first (and its bias), no model to the statistic.
    asked = test.withColumns({"reported": F.when(F.col("obs_id") % 2 == 0, F.col("delay_mins")), "preceding": F.lit(15)})
    statistic = test.select(*M.PATTERN).distinct().withColumns({"predicted": F.lit(5), "confidence": F.lit(0.5), "newest": F.lit(stamp(0, 0))})
    both = {r["obs_id"]: r for r in M.score(asked, statistic, run, day).collect()}
    raw = {r["obs_id"]: r["prediction"] for r in day.transform(M.vectors(test)).collect()}
    assert all(r["path"] == ("day_ahead" if i % 2 else "realtime") for i, r in both.items())
    assert all(r["predicted"] == int(raw[i] + 0.5) + 6 for i, r in both.items() if i % 2 and raw[i] > 0)
    assert all(r["confidence"] == min(1.0, r["sample_count_log"] / 4) for r in both.values())
    none = M.score(asked, statistic, as_of=str(stamp(42, 0))).collect()
    assert {(r["path"], r["predicted"], round(r["confidence"], 3)) for r in none} == {("statistic", 9, 0.068)}
    half = M.score(asked, statistic.limit(0), day_ahead=None, realtime=run).collect()
    assert {r["path"] for r in half} == {"realtime", None}
