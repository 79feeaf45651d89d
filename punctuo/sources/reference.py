"""Files of the timetable and of reference data: CSV with and without headers, and nested JSON.

Where the first (or last) row of a file counts, rows carry their place in the file: path, start of the split, and the row
number within it, all of which a parallel scan knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S

#: Fixed value: an end of validity that means none.
OPEN_END = "2999-12-31"
#: The box around Great Britain, as south, north, west, east.
BRITAIN = (49.0, 61.0, -8.5, 2.0)
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _placed(rows: DataFrame) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("r"))
    return rows.select("*", place.alias("file_order"))


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def with_header(spark: SparkSession, path: str, **wanted: str) -> DataFrame:
    """Columns of a CSV file by the names in its header, cast to the ``wanted`` types, and ``file_order``.

    Columns that the file lacks are null.  Rows of another length than the header, and rows with a value that is not of
    its type, are skipped; empty fields are null.
    """
    raw = _placed(spark.read.option("columnPruning", False).csv(path, header=True, mode="DROPMALFORMED"))
    text = {n: F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string") for n in wanted}
    good = F.lit(True)
    for n, kind in wanted.items():
        if kind != "string":
            good = good & (_blank(text[n]).isNull() | F.trim(text[n]).try_cast(kind).isNotNull())
    return raw.filter(good).select(*[(text[n] if k == "string" else F.trim(text[n]).try_cast(k)).alias(n) for n, k in wanted.items()], "file_order")


def positional(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Fields of a CSV file without a header as ``c0``..., trimmed, missing ones null, and ``file_order``."""
    raw = _placed(spark.read.schema(", ".join(f"c{i} string" for i in range(width))).csv(path, mode="PERMISSIVE", quote='"', escape='"'))
    return raw.select(*[F.trim(f"c{i}").alias(f"c{i}") for i in range(width)], "file_order")


def _first(rows: DataFrame, key: str, *columns: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in file order; partial aggregates meet before the shuffle."""
    best = (F.max_by if last else F.min_by)(F.struct(*columns), F.col("file_order"))
    return rows.groupBy(key).agg(best.alias("__b")).select(key, "__b.*")


# The timetable


def stops(spark: SparkSession, path: str) -> DataFrame:
    """Stations of stops.txt: rows whose id is three capital letters."""
    rows = with_header(spark, path, stop_id="string", stop_name="string", stop_lat="double", stop_lon="double")
    return rows.filter(S.valid_crs(F.col("stop_id"))).drop("file_order")


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """(service_id, mask): bits of the days it runs on, bit 0 = Monday; the last row of a service counts."""
    rows = with_header(spark, path, service_id="string", **{d: "int" for d in DAYS}).dropna(subset=["service_id", *DAYS])
    mask = sum((F.shiftleft(F.col(d), i) for i, d in enumerate(DAYS)), F.lit(0))
    return _first(rows.withColumn("mask", mask), "service_id", "mask", last=True)


def trips(spark: SparkSession, path: str) -> DataFrame:
    rows = with_header(spark, path, trip_id="string", service_id="string", route_id="string").dropna(subset=["trip_id", "service_id"])
    return rows.withColumn("uid", S.uid_from_trip(F.col("trip_id")))


def stop_times(spark: SparkSession, path: str) -> DataFrame:
    """Calls of each trip: (trip_id, position from 0 by stop_sequence, stop_id, crs, dep_secs, arr_secs); equal sequences
    keep the order of the file.  Hours past 24 are folded."""
    rows = with_header(spark, path, trip_id="string", stop_sequence="int", stop_id="string", departure_time="string", arrival_time="string")
    rows = rows.dropna(subset=["trip_id", "stop_sequence", "stop_id"])
    place = F.row_number().over(Window.partitionBy("trip_id").orderBy("stop_sequence", "file_order")) - 1
    clock = lambda c: S.gtfs_clock(F.trim(c))
    return rows.select("trip_id", place.alias("position"), "stop_id", S.stop_code_suffix(F.col("stop_id")).alias("crs"), clock("departure_time").alias("dep_secs"), clock("arrival_time").alias("arr_secs"))


def agencies(spark: SparkSession, path: str) -> DataFrame:
    """(agency_id, agency_name) of agency.txt; rows without an id are skipped, the last row of an id counts."""
    rows = with_header(spark, path, agency_id="string", agency_name="string").filter(_blank(F.col("agency_id")).isNotNull())
    return _first(rows, "agency_id", "agency_name", last=True)


def routes(spark: SparkSession, path: str) -> DataFrame:
    """(route_id, agency_id) of routes.txt; rows without an agency are skipped, the last row of a route counts."""
    rows = with_header(spark, path, route_id="string", agency_id="string").filter(_blank(F.col("agency_id")).isNotNull())
    return _first(rows, "route_id", "agency_id", last=True)


def uid_operators(trip_rows: DataFrame, route_rows: DataFrame) -> DataFrame:
    """(uid, toc): the agency of the first trip of a uid whose route has one."""
    found = trip_rows.filter("uid is not null").join(route_rows, "route_id").withColumnRenamed("agency_id", "toc")
    return _first(found, "uid", "toc")


def services(trip_rows: DataFrame, calls: DataFrame, days: DataFrame, operators: DataFrame, known: DataFrame) -> DataFrame:
    """(uid, origin_crs, destination_crs, runs_on_days, toc) of the first trip of each uid that has a calendar, two calls or
    more and a code at both ends; services with an end that is not among ``known`` (crs) stations are then dropped."""
    ends = calls.groupBy("trip_id").agg(
        F.min(F.struct("position", "crs")).alias("a"), F.max(F.struct("position", "crs")).alias("z"), F.count(F.lit(1)).alias("n")
    )
    ends = ends.filter("n >= 2 and a.crs is not null and z.crs is not null").select("trip_id", F.col("a.crs").alias("origin_crs"), F.col("z.crs").alias("destination_crs"))
    rows = trip_rows.filter("uid is not null").join(days, "service_id").join(ends, "trip_id")
    first = _first(rows, "uid", "origin_crs", "destination_crs", F.col("mask").alias("runs_on_days"))
    for end in ("origin_crs", "destination_crs"):
        first = first.join(known.select(F.col("crs").alias(end)).distinct(), end, "left_semi")
    return first.join(operators, "uid", "left").select("uid", "origin_crs", "destination_crs", "runs_on_days", "toc")


def timetable(trip_rows: DataFrame, calls: DataFrame, built: DataFrame, known: DataFrame, first_day: str, days: int = 7, respect_calendar: bool = False) -> DataFrame:
    """Calls of all trips of the ``built`` services on each of the next ``days``: uid, operating_date, location_crs, call_order,
    dep_secs, arr_secs, each (uid, date, order, place) once.

    The order is the position in the trip; calls at unknown stations are skipped.  With ``respect_calendar`` only the days
    that the service runs on.
    """
    rows = trip_rows.select("trip_id", "uid").join(built.select("uid", "runs_on_days"), "uid").join(calls, "trip_id")
    rows = rows.join(known.select("crs").distinct(), "crs", "left_semi")
    start = F.lit(first_day).cast("date")
    rows = rows.withColumn("operating_date", F.explode(F.sequence(start, F.date_add(start, days - 1))))
    if respect_calendar:
        rows = rows.filter("shiftright(runs_on_days, weekday(operating_date)) & 1 = 1")
    return rows.select("uid", "operating_date", F.col("crs").alias("location_crs"), F.col("position").alias("call_order"), "dep_secs", "arr_secs").distinct()


# Reference data without headers


def station_coords(spark: SparkSession, path: str) -> DataFrame:
    """(nlc, lon, lat): what is no number is 0, and 0, 0 is no place; the last row of a code counts."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    rows = positional(spark, path, 4).select(F.col("c1").alias("nlc"), number("c2").alias("lon"), number("c3").alias("lat"), "file_order")
    return _first(rows.filter("nlc <> '' and not (lon = 0 and lat = 0)"), "nlc", "lon", "lat", last=True)


def station_master(spark: SparkSession, path: str, coords: DataFrame) -> DataFrame:
    """(crs, name, nlc, lat, lon): the first row of each code of three characters, with the coordinates of its NLC."""
    rows = positional(spark, path, 8).filter("length(c7) = 3").select(F.col("c7").alias("crs"), F.coalesce("c1", F.lit("")).alias("name"), F.coalesce("c6", F.lit("")).alias("nlc"), "file_order")
    return _first(rows, "crs", "name", "nlc").join(coords, "nlc", "left").select("crs", "name", "nlc", "lat", "lon")


def operator_master(spark: SparkSession, path: str) -> DataFrame:
    """(toc, name): the first row of each code that has a name."""
    rows = positional(spark, path, 3).filter("c1 <> '' and c2 <> ''").select(F.col("c1").alias("toc"), F.col("c2").alias("name"), "file_order")
    return _first(rows, "toc", "name")


def catalog(spark: SparkSession, path: str, since: int, until: int) -> DataFrame:
    """(code, name, valid_from, valid_to) of a code table whose validity is in columns ``since`` and ``until``; an open end is null."""
    rows = positional(spark, path, max(since, until) + 1).filter("c1 <> ''")
    day = lambda i: F.try_to_date(F.substring(f"c{i}", 1, 10), "yyyy-MM-dd")
    return rows.select(F.col("c1").alias("code"), F.col("c2").alias("name"), day(since).alias("valid_from"), F.nullif(day(until), F.lit(OPEN_END).cast("date")).alias("valid_to"))


# Nested JSON


def history(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Delay rows (uid, origin_crs, weekday, departure_hour, delay_mins, recorded_at) of service details: one a call that has
    both times and is at a ``known`` (crs) station.  The uid is what follows the date in the rid."""
    call = "struct<location: string, gbtt_ptd: string, actual_td: string>"
    schema = f"serviceAttributesDetails struct<date_of_service: string, rid: string, locations: array<{call}>>"
    rows = spark.read.schema(schema).json(path, multiLine=False).select("serviceAttributesDetails.*")
    rows = rows.select("rid", F.try_to_date("date_of_service", "yyyy-MM-dd").alias("day"), F.explode("locations").alias("c"))
    due, left = F.col("c.gbtt_ptd"), F.col("c.actual_td")
    both = due.rlike("^[0-9]{4}") & left.rlike("^[0-9]{4}") & (F.substring(due, 1, 2) < "24") & (F.substring(due, 3, 2) < "60")
    rows = rows.filter(both & F.col("day").isNotNull()).withColumn("origin_crs", F.substring(F.upper(F.trim("c.location")), 1, 3))
    rows = rows.join(known.select(F.col("crs").alias("origin_crs")).distinct(), "origin_crs", "left_semi")
    delay, hour = S.hist_wrapped_delay(due, left), F.substring(due, 1, 2).cast("int")
    uid = F.when(F.col("rid").rlike("^[0-9]{8}."), F.substring("rid", 9, 100)).otherwise(F.col("rid"))
    at = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + hour * 3600 + F.substring(due, 3, 2).cast("int") * 60)
    found = rows.select(uid.alias("uid"), "origin_crs", F.weekday("day").alias("weekday"), hour.alias("departure_hour"), delay.alias("delay_mins"), at.alias("recorded_at"))
    return found.filter(S.sane(F.col("delay_mins")))


def map_stations(spark: SparkSession, path: str) -> DataFrame:
    """(crs, name, lat, lon, tiploc) of map nodes, read in the order of the file: the first node of a code counts, but a blank
    tiploc is filled from the first later node that has one.  Names are the English, else the plain, else the official one."""
    tags = "struct<`ref:crs`: string, `ref:tiploc`: string, `name:en`: string, name: string, official_name: string>"
    raw = _placed(spark.read.schema(f"elements array<struct<lat: double, lon: double, tags: {tags}>>").json(path, multiLine=True))
    rows = raw.select("file_order", F.posexplode("elements").alias("pos", "e")).withColumn("file_order", F.struct("file_order", "pos"))
    tag = lambda n: F.col("e.tags").getField(n)
    name = F.trim(F.coalesce(*[F.nullif(tag(n), F.lit("")) for n in ("name:en", "name", "official_name")], F.lit("")))
    rows = rows.select(F.upper(F.trim(tag("ref:crs"))).alias("crs"), name.alias("name"), "e.lat", "e.lon", _blank(F.upper(tag("ref:tiploc"))).alias("tiploc"), "file_order")
    rows = rows.filter(F.col("crs").rlike("^[A-Z]{3}$") & (F.col("name") != ""))
    tiploc = F.min_by("tiploc", F.when(F.col("tiploc").isNotNull(), F.col("file_order")))
    best = rows.groupBy("crs").agg(F.min_by(F.struct("name", "lat", "lon"), F.col("file_order")).alias("b"), tiploc.alias("tiploc"))
    return best.select("crs", "b.*", "tiploc")


def locations(spark: SparkSession, path: str) -> DataFrame:
    """(tiploc, lat, lon) of a location list (one object a line): places in Great Britain, the first of each code."""
    raw = _placed(spark.read.schema("tiploc string, lat double, lon double").json(path))
    south, north, west, east = BRITAIN
    rows = raw.withColumn("tiploc", _blank(F.upper("tiploc"))).filter("tiploc is not null and lat <> 0 and lon <> 0")
    rows = rows.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return _first(rows, "tiploc", "lat", "lon")


def weather_hourly(spark: SparkSession, path: str) -> DataFrame:
    """(hour, wind) of parallel arrays of times and speeds; a missing speed is 0."""
    raw = spark.read.schema("hourly struct<time: array<string>, wind_speed_10m: array<double>>").json(path, multiLine=True)
    rows = raw.select(F.explode(F.arrays_zip(F.col("hourly.time").alias("t"), F.col("hourly.wind_speed_10m").alias("w"))).alias("x"))
    return rows.select(F.try_to_timestamp("x.t", F.lit("yyyy-MM-dd'T'HH:mm")).alias("hour"), F.coalesce("x.w", F.lit(0.0)).alias("wind")).dropna(subset=["hour"])
