"""Readers of timetable and reference files on files by hand."""

import datetime as dt
import json

import pytest

from punctuo.sources import reference as R


@pytest.fixture
def put(tmp_path):
    def write(text, name="f.txt", parts=1):
        folder = tmp_path / name
        folder.mkdir()
        for i, t in enumerate(text if isinstance(text, list) else [text]):
            (folder / f"part-{i:03}").write_text(t, encoding="utf-8")
        return f"file://{folder}"

    return write


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


STOPS = "stop_id,stop_name,stop_lat,stop_lon\nLDS,Leeds,53.7952,-1.5479\nMAN,Manchester Piccadilly,53.4772,-2.2309\nKGX,\"London, Kings Cross\",51.5308,-0.1238\nPLT1,Leeds Platform 1,,\nabc,lowercase should be skipped,,\n"


def test_stops(spark, put):
    got = rows(R.stops(spark, put(STOPS)))
    assert [r[0] for r in got] == ["KGX", "LDS", "MAN"] and got[0][1] == "London, Kings Cross"
    assert rows(R.stops(spark, put("stop_id,stop_name,stop_lat,stop_lon\nLDS,Leeds,,\n", "b"))) == [("LDS", "Leeds", None, None)]
    assert rows(R.stops(spark, put("stop_lon,stop_id,stop_lat,stop_name\n1,XYZ,north,Bad\n2,ABC,3,Good\n4,SHT\n", "c"))) == [("ABC", "Good", 3.0, 2.0)]
    assert rows(R.stops(spark, put("stop_id,stop_name,stop_lat,stop_lon\n", "d"))) == []


def test_calendar(spark, put):
    head = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\n"
    text = head + "WD,1,1,1,1,1,0,0\nWE,0,0,0,0,0,1,1\nBAD,1,1,x,1,1,1,1\nWE,0,0,0,0,0,0,1\n"
    assert rows(R.calendar(spark, put(text))) == [("WD", 31), ("WE", 64)]


TRIPS = [
    "trip_id,service_id,route_id\nC12345_1,NONE,R9\nC12345_2,WD,R1\nC1_2,WD,R1\nG00001_1,WD,R2\n",
    "trip_id,service_id,route_id\nG00001_2,WD,R1\nC12345_3,WE,R3\nH00001_1,WD,R1\nK00001-x_1,WD,R1\n",
]
TIMES = (
    "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nC12345_2,08:00:00,08:01:00,9100LEEDS,20\nC12345_2,07:00:00,07:01:00,9100YRK,10\n"
    "C12345_2,25:30:00,25:31:00,MAN,30\nC12345_3,10:00:00,10:00:00,LDS,1\nC12345_3,11:00:00,11:00:00,MAN,2\nG00001_1,09:00:00,09:00:00,LDS,1\n"
    "G00001_2,bad,09:30:00,LDS,1\nG00001_2,09:40:00,09:41:00,x9,2\nG00001_2,10:00:00,10:00:00,YRK,3\nH00001_1,1:00:00,1:00:00,lds,1\n"
    "H00001_1,2:00:00,2:00:00,YRK,2\nK00001-x_1,1:00:00,1:00:00,LDS,1\nK00001-x_1,2:00:00,2:00:00,ZZZ,1\nK00001-x_1,2:00:00,2:00:00,ZZZ,q\n"
)


def test_timetable_from_files(spark, put):
    trips = R.trips(spark, put(TRIPS, "trips"))
    calls = R.stop_times(spark, put(TIMES, "times"))
    days = R.calendar(spark, put("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nWD,1,1,1,1,1,0,0\nWE,0,0,0,0,0,1,1\n", "calendar"))
    routes = R.routes(spark, put("route_id,agency_id\nR1,A1\nR2,\nR3,A3\nR1,A2\n", "routes"))
    assert rows(R.agencies(spark, put("agency_id,agency_name\nA1,One\n,None\nA1,Uno\n", "agency"))) == [("A1", "Uno")]
    assert rows(routes) == [("R1", "A2"), ("R3", "A3")]
    operators = R.uid_operators(trips, routes)
    assert rows(operators) == [("C12345", "A2"), ("G00001", "A2"), ("H00001", "A2"), ("K00001", "A2")]
    assert [r[1:4] for r in sorted(rows(calls.filter("trip_id = 'C12345_2'")))] == [(0, "9100YRK", "YRK"), (1, "9100LEEDS", "EDS"), (2, "MAN", "MAN")]
    known = spark.createDataFrame([("LDS",), ("MAN",), ("YRK",)], "crs string")
    built = R.services(trips, calls, days, operators, known)
    # C12345's first trip has no calendar; G00001's first has one call; H00001 starts nowhere, K00001 ends at an unknown place.
    assert rows(built) == [("C12345", "YRK", "MAN", 31, "A2"), ("G00001", "LDS", "YRK", 31, "A2")]
    table = R.timetable(trips, calls, built, known, "2024-04-17")
    assert table.select("operating_date").distinct().count() == 7
    got = rows(table.filter("operating_date = date'2024-04-18'").drop("operating_date"))
    assert got == [
        ("C12345", "LDS", 0, 36000, 36000), ("C12345", "MAN", 1, 39600, 39600), ("C12345", "MAN", 2, 5460, 5400), ("C12345", "YRK", 0, 25260, 25200),
        ("G00001", "LDS", 0, 32400, 32400), ("G00001", "LDS", 0, 34200, None), ("G00001", "YRK", 2, 36000, 36000),
    ]
    runs = R.timetable(trips, calls, built, known, "2024-04-17", respect_calendar=True).select("operating_date").distinct().collect()
    assert sorted(r[0].day for r in runs) == [17, 18, 19, 22, 23]


def test_station_master_takes_the_first_row(spark, put):
    coords = R.station_coords(spark, put("1,1111,-1.5,53.7\n2,2222,0,0\n3,3333,x,51.0\n4,,1,1\n5,1111,-1.6,53.8\n6,4444,0.1,0\n", "coords"))
    assert rows(coords) == [("1111", -1.6, 53.8), ("3333", 0.0, 51.0), ("4444", 0.1, 0.0)]
    a = "1,LEEDS,a,b,c,d,1111,LDS,x\n2,SECOND,a,b,c,d,3333,LDS\n3,GROUP,a,b,c,d,1111\n4,\"YORK, N\",a,b,c,d, 9999 , YRK \n"
    found = R.station_master(spark, put([a, "9,LATER,a,b,c,d,1111,YRK\n8,NEW,a,b,c,d,,NEW\n"], "stations"), coords)
    assert rows(found) == [("LDS", "LEEDS", "1111", 53.8, -1.6), ("NEW", "NEW", "", None, None), ("YRK", "YORK, N", "9999", None, None)]


def test_operators_and_catalogues(spark, put):
    assert rows(R.operator_master(spark, put("1,AR,ANGLIA,AR.png\n2,AR,OTHER\n3,,NONE\n4,XX, \n5,XX,LAST\n"))) == [("AR", "ANGLIA"), ("XX", "LAST")]
    text = "1,WEB,11% WEB DISC,a,b,c,d,2015-09-08 00:00:00,2999-12-31 00:00:00\n2,OLD,Old,a,b,c,d,2015-09-08,2016-01-01\n3,,none,a,b,c,d,,\n4,ODD,Odd,a,b,c,d,soon,\n"
    day = dt.date(2015, 9, 8)
    assert rows(R.catalog(spark, put(text, "cards"), 7, 8)) == [("ODD", "Odd", None, None), ("OLD", "Old", day, dt.date(2016, 1, 1)), ("WEB", "11% WEB DISC", day, None)]


def test_history(spark, put):
    def service(rid, day, *calls):
        return json.dumps({"serviceAttributesDetails": {"date_of_service": day, "rid": rid, "locations": [dict(zip(("location", "gbtt_ptd", "actual_td"), c)) for c in calls]}})

    text = "\n".join([
        service("202404177000001", "2024-04-17", ("lds ", "2355", "0005"), ("LDSX", "0900", "0858"), ("ABC", "0900", "0901"), ("LDS", "", "0900"), ("LDS", "0900", ""), ("LDS", "1000", "2030"), ("LDS", "9x00", "0900")),
        service("77", "2024-04-21", ("LDS", "0001", "2359")), "{}", "not json",
    ])
    known = spark.createDataFrame([("LDS",)], "crs string")
    got = rows(R.history(spark, put(text), known))
    assert got == [("7000001", "LDS", 2, 23, 10, dt.datetime(2024, 4, 17, 23, 55)), ("7000001", "LDS", 2, 9, -2, dt.datetime(2024, 4, 17, 9)), ("77", "LDS", 6, 0, -2, dt.datetime(2024, 4, 21, 0, 1))]


def test_map_stations(spark, put):
    node = lambda lat, **tags: {"lat": lat, "lon": 1.0, "tags": {k.replace("_", ":", 1) if k != "official_name" else k: v for k, v in tags.items()}}
    a = {"elements": [node(1.0, ref_crs="lds ", name="Leeds"), node(2.0, ref_crs="LDS", name="Later", ref_tiploc="leeds"), node(3.0, ref_crs="LDS", name="Last", ref_tiploc="OTHER"),
                      node(4.0, ref_crs="L1S", name="Bad"), node(5.0, ref_crs="YRK"), node(6.0, ref_crs="MAN", name="Plain", name_en="English", official_name="Long", ref_tiploc=" "), {"lat": 7.0, "lon": 1.0}]}
    b = {"elements": [node(8.0, ref_crs="YRK", official_name="York Station", ref_tiploc="YORK"), node(9.0, ref_crs="MAN", name="X", ref_tiploc="MNCR")]}
    got = rows(R.map_stations(spark, put([json.dumps(a), json.dumps(b)])))
    assert got == [("LDS", "Leeds", 1.0, 1.0, "LEEDS"), ("MAN", "English", 6.0, 1.0, "MNCR"), ("YRK", "York Station", 8.0, 1.0, "YORK")]


def test_locations_and_weather(spark, put):
    lines = [{"tiploc": " leeds", "lat": 53.8, "lon": -1.5}, {"tiploc": "LEEDS", "lat": 50.0, "lon": -1.0}, {"tiploc": "PARIS", "lat": 48.8, "lon": 2.3}, {"tiploc": "ZERO", "lat": 0, "lon": -1}, {"tiploc": "", "lat": 51, "lon": 0.1}]
    assert rows(R.locations(spark, put("\n".join(map(json.dumps, lines))))) == [("LEEDS", 53.8, -1.5)]
    text = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "bad"], "wind_speed_10m": [12.5, None, 3]}})
    assert rows(R.weather_hourly(spark, put(text, "w"))) == [(dt.datetime(2024, 1, 1, 0), 12.5), (dt.datetime(2024, 1, 1, 1), 0.0)]


def test_file_order_survives_splits(spark, put):
    text = "".join(f"{i},T{i % 700:03},name {i}\n" for i in range(20_000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = dict(rows(R.operator_master(spark, put([text, text.replace("name", "late")]))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"T{k:03}": f"name {k}" for k in range(700)}
