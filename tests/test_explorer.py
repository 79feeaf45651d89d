"""The guided query's checks and answers, and the full board, by hand."""

import datetime as dt

import pytest

from punctuo.operators import explorer as E
from punctuo.operators import live as B

NOW = dt.datetime(2024, 4, 17, 12)


@pytest.mark.parametrize("raw,want", [
    ({"window": "nonsense"}, {"hours": 168}), ({"window": "24h"}, {"hours": 24}), ({"window": "all"}, {"hours": 876000}),
    ({"from_hour": 99, "to_hour": -5}, {"from_hour": 23, "to_hour": 0}), ({"weekdays": "9,1,bad,3"}, {"weekdays": (1, 3)}), ({"limit": 9999}, {"limit": 500}),
    ({"limit": 0}, {"limit": 1}), ({"limit": "x"}, {"limit": 200}), ({"origin": " lds "}, {"origin": "LDS"}), ({"origin": "LEEDS", "destination": "L1S"}, {"origin": None, "destination": None}),
    ({"since": "2024-02-30", "until": "2024-02-28"}, {"since": None, "until": dt.date(2024, 2, 28)}), ({"subject": "predictions", "measure": "p90"}, {"subject": "predictions", "measure": "count"}),
    ({"subject": "predictions", "measure": "mae"}, {"measure": "mae"}), ({"subject": "cancellations", "measure": "avg_delay"}, {"measure": "count"}), ({"subject": "'; drop"}, {"subject": "observations", "measure": "list"}),
    ({"group": "route"}, {"group": "route"}), ({"group": "1; --"}, {"group": "none"}), ({"operator": "  "}, {"operator": None}), ({"min_delay": "-7"}, {"min_delay": -7}), ({}, {"limit": 200}),
])
def test_questions_are_checked(raw, want):
    q = E.ask(raw)
    assert {k: getattr(q, k) for k in want} == want


@pytest.fixture(scope="module")
def seed(spark):
    at = lambda h: NOW - dt.timedelta(hours=h)
    rows = [("C1", "LDS", 7, 2, at(1)), ("C1", "LDS", 8, 4, at(2)), ("C1", "LDS", 7, 2, at(30)), ("G1", "MAN", 14, 10, at(3)), ("X1", "MAN", 8, 700, at(3)), ("X1", "MAN", 8, 1, at(200))]
    obs = spark.createDataFrame(rows, "uid string, origin_crs string, departure_hour int, delay_mins int, recorded_at timestamp").selectExpr("*", "weekday(recorded_at) AS weekday")
    services = spark.createDataFrame([("C1", "HX", "KGX"), ("G1", "GW", None)], "uid string, toc string, destination_crs string")
    return obs, services


def ask(seed, **raw):
    q = E.ask(raw)
    return [tuple(r) for r in (E.listed if q.measure == "list" else E.answer)(q, *seed, str(NOW)).collect()]


def test_answers(seed):
    assert ask(seed, operator="HX", group="hour", measure="avg_delay", from_hour=6, to_hour=10) == [("07:00", 2.0, 2), ("08:00", 4.0, 1)]
    assert ask(seed, operator="HX", measure="p50") == [("All", 2.0, 3)]
    assert ask(seed, since="2030-01-01", measure="count") == [("All", 0.0, 0)]
    assert ask(seed, window="24h", group="route", measure="count") == [("LDS → KGX", 2.0, 2), ("MAN → ?", 1.0, 1)]
    assert ask(seed, window="30d", group="operator", measure="on_time_pct") == [("HX", 0.0, 3), ("GW", 0.0, 1), ("Unknown", 0.0, 1)]
    assert [r[0] for r in ask(seed, limit=2)] == ["C1", "C1"] and ask(seed, origin="MAN")[0][1:3] == ("MAN", "GW")


def board(spark, planned, trains):
    schema = ("rid string, origin string, destination string, departure timestamp, estimated timestamp, reported int, predicted int, live_platform string, "
              "planned_platform string, is_cancelled boolean, estimated_at timestamp, reported_at timestamp, platform_at timestamp, cancelled_at timestamp")  # fmt: skip
    stations = spark.createDataFrame([("LDS", "LEEDS"), ("YRK", None), ("MAN", "")], "crs string, tiploc string")
    live = B.station_snapshot(spark.createDataFrame(trains, schema), stations, str(NOW))
    names = spark.createDataFrame([("MAN", "Manchester"), ("MNCRPIC", "Manchester Piccadilly")], "code string, name string")
    table = spark.createDataFrame(planned, "place string, uid string, call_order int, departure timestamp, platform string")
    return [r.asDict() for r in B.station_board(table, live, names).orderBy("place", "departure", "rid").collect()]


def train(rid, origin, at, destination=None, reported=None, platform=None, predicted=None):
    return (rid, origin, destination, at, None, reported, predicted, platform, None, None, None, NOW - dt.timedelta(seconds=50), NOW - dt.timedelta(seconds=40), None)


NINE = dt.datetime(2024, 4, 17, 9)


def test_planned_alone_goes_by_its_uid(spark):
    (e,) = board(spark, [("LDS", "C12345 ", 0, NINE, "1")], [])
    assert (e["rid"], e["delay_mins"], e["platform"], e["is_platform_planned"], e["secs_ago"]) == ("C12345", None, "1", True, None)


def test_the_live_train_wins(spark):
    rows = [train("r2", "leeds", NINE + dt.timedelta(seconds=120), "MNCRPIC", 5, "9"), train("r3", "LDS", NINE + dt.timedelta(seconds=121)), train("r4", "YRK", NINE, "MAN", None, None, 3), train("r5", "XXX", NINE)]
    a, b = board(spark, [("LDS", "C12345", 0, NINE, "1")], rows)
    assert (a["rid"], a["delay_mins"], a["platform"], a["is_platform_planned"], a["secs_ago"], a["destination_name"]) == ("r2", 5, "9", False, 40, "Manchester Piccadilly")
    assert (b["place"], b["rid"], b["delay_mins"], b["is_platform_planned"], b["destination_name"]) == ("YRK", "r4", 3, False, "MAN")


def test_no_live_platform_leaves_the_planned_one(spark):
    (e,) = board(spark, [("LDS", "C1", 0, NINE, "1")], [train("r1", "LDS", NINE, "ZZZ")])
    assert (e["rid"], e["platform"], e["is_platform_planned"], e["destination_name"]) == ("r1", "1", True, None)
