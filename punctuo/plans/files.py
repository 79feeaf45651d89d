"""File readers, the timetable built from files, and sinks: (name, query over the views, DuckDB SQL over the same views).

The given tables hold no such files, so Spark writes them from the views, in the formats of the sources, and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.sources import reference as R
from punctuo.sources import sinks
from punctuo.sources.shared import new_path

C = F.col
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letters(n: str) -> str:
    """Three letters for a number, as SQL that both engines read."""
    at = (f"CAST(floor({n} / 676.0) AS INT) % 26", f"CAST(floor({n} / 26.0) AS INT) % 26", f"CAST({n} AS INT) % 26")
    return " || ".join(f"substr('{LETTERS}', {i} + 1, 1)" for i in at)


#: Stations by number: every thirteenth has no proper code, every tenth is missing from the list of stops.
PLACES = f"SELECT s_suppkey AS n, CASE WHEN s_suppkey % 13 = 0 THEN 'x' ELSE '' END AS odd, {_letters('s_suppkey')} AS code, s_name AS name FROM supplier"
STOPS = f"SELECT CAST(substr(tpl, 2) AS INT) AS n, rid, seq, tpl, sched_arr, sched_dep, CAST(rid AS BIGINT) AS number, {_letters('CAST(substr(tpl, 2) AS INT)')} AS code FROM journey_calls"


def _lines(df: DataFrame, columns: list, name: str, order: list[str], header: str | None = None, files: int | None = 1) -> str:
    """Rows as lines of comma-separated text in order, in one file or in several that follow each other by name.

    Tables that grow are written without a number of ``files``, in as many as Spark deals a shuffle into."""
    text = df.select(F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).alias("value"), *order)
    path = new_path(df.sparkSession, name)
    text = text.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).select("value")
    if header:
        head, rest = header.split(","), F.split("value", ",", -1)
        text.select(*[rest[i].alias(h) for i, h in enumerate(head)]).write.option("header", True).option("emptyValue", "").csv(path)
    else:
        text.write.text(path)
    return path


def _stops_file(v) -> str:
    rows = v.sql(PLACES).filter("n % 10 <> 3")
    number = F.when(C("n") % 7 == 0, "").when(C("n") % 11 == 0, "north").otherwise((C("n") / 10.0).cast("string"))
    return _lines(rows, [F.concat("odd", "code"), C("name"), number, F.lit("1.5")], "stops", ["n"], "stop_id,stop_name,stop_lat,stop_lon")


def _calendar_file(v) -> str:
    mask = (C("k") * 37 + 11) % 128
    days = [F.when(C("k") == 5, "x").otherwise(F.shiftright(mask.cast("int"), i).bitwiseAND(1).cast("string")) for i in range(7)]
    rows = v.nation.select((C("n_nationkey") % 9).cast("int").alias("k"), C("n_nationkey").alias("o"))
    return _lines(rows, [F.concat(F.lit("S"), C("k").cast("string")), *days], "calendar", ["o"], "service_id," + ",".join(R.DAYS))


def _routes_file(v) -> str:
    rows = v.nation.select(C("n_nationkey").alias("k"))
    agency = F.when(C("k") % 5 == 2, "").otherwise(F.concat(F.lit("A"), (C("k") % 4).cast("string")))
    return _lines(rows, [F.concat(F.lit("R"), C("k").cast("string")), agency], "routes", ["k"], "route_id,agency_id")


def _agency_file(v) -> str:
    rows = v.nation.select(C("n_nationkey").alias("k"), C("n_name").alias("name"))
    return _lines(rows, [F.when(C("k") % 6 == 5, "").otherwise(F.concat(F.lit("A"), (C("k") % 6).cast("string"))), C("name")], "agency", ["k"], "agency_id,agency_name")


def _trips_file(v) -> str:
    rows = v.sql("SELECT DISTINCT rid, CAST(rid AS BIGINT) AS number FROM journey_calls")
    uid = F.concat(F.when(C("number") % 19 == 0, "c_").otherwise("C"), F.lpad((C("number") % 997).cast("string"), 5, "0"))
    columns = [F.concat(uid, F.lit("_"), "rid"), F.concat(F.lit("S"), (C("number") % 11).cast("string")), F.concat(F.lit("R"), (C("number") % 30).cast("string"))]
    return _lines(rows, columns, "trips", ["number"], "trip_id,service_id,route_id", files=None)


def _times_file(v) -> str:
    rows = v.sql(STOPS)
    uid = F.concat(F.when(C("number") % 19 == 0, "c_").otherwise("C"), F.lpad((C("number") % 997).cast("string"), 5, "0"))
    clock = lambda t: F.concat((F.hour(t) + F.when(C("seq") % 5 == 4, 24).otherwise(0)).cast("string"), F.date_format(t, ":mm:ss"))
    stop = F.concat(F.lit("9100"), F.when(C("n") % 13 == 0, F.lower("code")).otherwise(C("code")))
    columns = [F.concat(uid, F.lit("_"), "rid"), F.when(C("seq") == 3, "late").otherwise(clock("sched_arr")), clock("sched_dep"), stop, (C("seq") * 10).cast("string")]
    return _lines(rows, columns, "stop-times", ["tpl", "number", "seq"], "trip_id,arrival_time,departure_time,stop_id,stop_sequence", files=None)


def _known(v) -> DataFrame:
    return R.stops(v.spark, _stops_file(v)).select(C("stop_id").alias("crs"))


def _built(v):
    trips, calls = R.trips(v.spark, _trips_file(v)), R.stop_times(v.spark, _times_file(v))
    operators = R.uid_operators(trips, R.routes(v.spark, _routes_file(v)))
    known = _known(v)
    return trips, calls, R.services(trips, calls, R.calendar(v.spark, _calendar_file(v)), operators, known), known


def _timetable(v) -> DataFrame:
    trips, calls, built, known = _built(v)
    found = R.timetable(trips, calls, built, known, "2024-01-01", respect_calendar=True)
    return found.groupBy("uid", "operating_date").agg(F.count(F.lit(1)).alias("n_calls"), F.min("dep_secs").alias("first_dep"), F.sum("call_order").alias("orders"), F.count("arr_secs").alias("arrivals"))


def _coords_file(v) -> str:
    rows = v.sql(PLACES)
    lon = F.when(C("n") % 5 == 0, F.lit(0.0)).otherwise(C("n") / 8.0)
    lat = F.when(C("n") % 5 == 0, F.lit(0.0)).otherwise(50 + C("n") / 16.0)
    return _lines(rows, [C("n"), F.lpad((C("n") % 60).cast("string"), 4, "0"), lon, lat], "coords", ["n"])


def _stations_file(v) -> str:
    """Codes repeat: two suppliers of one code differ in name; blank codes are groups."""
    rows = v.sql(PLACES)
    code = F.when(C("n") % 9 == 0, "").otherwise(F.expr(_letters("n % 70")))
    fill = [F.lit("")] * 4
    return _lines(rows, [C("n"), C("name"), *fill, F.lpad((C("n") % 80).cast("string"), 4, "0"), code], "stations", ["n"], files=2)


def _operators_file(v) -> str:
    rows = v.sql(PLACES)
    return _lines(rows, [C("n"), F.when(C("n") % 8 == 0, "").otherwise(F.concat(F.lit("T"), (C("n") % 30).cast("string"))), F.when(C("n") % 6 == 0, " ").otherwise(C("name"))], "operators", ["n"])


def _catalog_file(v) -> str:
    rows = v.sql("SELECT o_orderkey AS n, CAST(o_orderdate AS DATE) AS day FROM orders")
    until = F.when(C("n") % 3 == 0, "2999-12-31 00:00:00").otherwise(F.date_format(F.date_add("day", 90), "yyyy-MM-dd HH:mm:ss"))
    return _lines(rows, [C("n"), F.concat(F.lit("K"), C("n").cast("string")), F.lit("name"), *[F.lit("")] * 4, F.date_format("day", "yyyy-MM-dd"), until], "catalog", ["n"], files=None)


def _json(df: DataFrame, value, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.select(F.to_json(value).alias("value")).write.text(path)
    return path


def _history(v) -> DataFrame:
    """Service details of trains; delays past half a day wrap, those out of range go."""
    rows = v.sql(STOPS).filter("number % 5 > 0")
    left = C("sched_dep") + F.make_dt_interval(F.lit(0), F.lit(0), (C("number") % 1000).cast("int"))
    call = F.struct(F.when(C("n") % 10 == 3, F.concat(F.lit("9"), F.lower("code"))).otherwise(F.lower("code")).alias("location"),
        F.when(C("seq") % 4 == 3, "").otherwise(F.date_format("sched_dep", "HHmm")).alias("gbtt_ptd"), F.date_format(left, "HHmm").alias("actual_td"))
    day = F.date_format(F.min("sched_dep"), "yyyy-MM-dd")
    trains = rows.groupBy("rid", "number").agg(F.collect_list(call).alias("locations"), day.alias("date_of_service"))
    path = _json(trains, F.struct(F.struct("date_of_service", F.concat(F.lit("20240101"), F.right("rid", F.lit(7))).alias("rid"), "locations").alias("serviceAttributesDetails")), "history")
    return R.history(v.spark, path, v.sql(f"SELECT code AS crs FROM ({PLACES}) p WHERE n % 10 <> 3")).withColumn("recorded_at", F.date_format("recorded_at", "yyyy-MM-dd HH:mm"))


def _map_stations(v) -> DataFrame:
    rows = v.sql(PLACES)
    code = F.when(C("n") % 9 == 0, "A1").otherwise(F.expr(_letters("n % 70")))
    tags = F.struct(F.lower(code).alias("ref:crs"), F.when(C("n") % 3 == 0, F.concat(F.lit("t"), C("n").cast("string"))).alias("ref:tiploc"),
        F.when(C("n") % 4 == 0, C("name")).alias("name"), F.when(C("n") % 4 == 1, F.concat(F.lit("Old "), "name")).alias("official_name"))
    node = F.struct((C("n") * 1.0).alias("lat"), F.lit(1.0).alias("lon"), tags.alias("tags"))
    path = _json(rows.coalesce(1).agg(F.array_sort(F.collect_list(F.struct("n", node.alias("e")))).alias("x")), F.struct(F.transform("x", lambda x: x["e"]).alias("elements")), "map")
    return R.map_stations(v.spark, path)


def _locations(v) -> DataFrame:
    """Copies of each place: the first in Britain counts."""
    rows = v.sql("SELECT c_custkey AS n FROM customer").coalesce(1).sortWithinPartitions("n")
    value = F.struct(F.concat(F.lit(" t"), (C("n") % 400).cast("string")).alias("tiploc"), (F.lit(48.0) + (C("n") % 1300) / 100.0).alias("lat"), (F.lit(-9.0) + (C("n") % 1100) / 100.0).alias("lon"))
    return R.locations(v.spark, _json(rows, value, "locations"))


def _weather(v) -> DataFrame:
    rows = v.weather_hourly.groupBy(F.to_date("hour").alias("d")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hour", "wind"))), lambda x: F.struct(F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm").alias("t"), F.when(x["wind"] % 7 > 0, x["wind"].cast("double")).alias("w"))).alias("x")
    )
    value = F.struct(F.struct(F.transform("x", lambda x: x["t"]).alias("time"), F.transform("x", lambda x: x["w"]).alias("wind_speed_10m")).alias("hourly"))
    path = new_path(v.spark, "weather")
    rows.select(F.to_json(value, {"ignoreNullFields": "false"}).alias("value")).repartition("value").write.text(path)
    found = v.spark.read.text(path, wholetext=False)  # one document a line here, one a file at the source
    out = new_path(v.spark, "weather-files")
    found.write.option("maxRecordsPerFile", 1).text(out)
    return R.weather_hourly(v.spark, out).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


def _history_sink(v) -> DataFrame:
    """Observations appended once a key, the first half, then all, then all again."""
    path, key = new_path(v.spark, "observations"), ["uid", "weekday", "origin_crs", "departure_hour", "day"]
    rows = v.observations.withColumn("day", F.to_date("recorded_at")).select(*key, "obs_id", "delay_mins")
    for part in (rows.filter("obs_id % 2 = 0"), rows, rows):
        sinks.append_once(part, path, key, "day", ["obs_id"])
    return v.spark.read.schema(rows.schema).parquet(path).select("obs_id", "delay_mins")


def _journey_sink(v) -> DataFrame:
    """Calls of journeys, each (day, rid, seq) once, from batches that overlap."""
    path = new_path(v.spark, "journey-calls")
    rows = v.journey_calls.withColumn("day", F.to_date(F.date_trunc("year", "sched_dep"))).select("day", "rid", "seq", "tpl")
    for part in (rows.filter("seq < 3"), rows.filter("seq > 1")):
        sinks.append_once(part, path, ["day", "rid", "seq"], "day", ["tpl"])
    return v.spark.read.schema(rows.schema).parquet(path).groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("seqs"))


def _replaced(v) -> DataFrame:
    """Generations: one is written, replaced by other rows, and another is left alone."""
    path = new_path(v.spark, "generations")
    rows = v.observations.select("obs_id", F.when(C("obs_id") % 2 == 0, "g0").otherwise("g1").alias("generation"))
    sinks.replace_partitions(rows, path, "generation")
    sinks.replace_partitions(rows.filter("generation = 'g1' and obs_id % 3 = 0"), path, "generation")
    return v.spark.read.parquet(path).groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.sum("obs_id").alias("total"))


def _exported(v) -> DataFrame:
    """A report as CSV and as JSON, read again by their plain readers."""
    a, b = new_path(v.spark, "csv"), new_path(v.spark, "json")
    rows = v.nation.select("n_nationkey", F.concat(F.lit('say "'), "n_name", F.lit('", twice')).alias("label"))
    sinks.export_csv(rows, a)
    sinks.export_json(rows, b)
    read = v.spark.read.schema("n_nationkey long, label string")
    return read.option("header", True).option("escape", '"').csv(a).join(v.spark.read.schema("n_nationkey long, label string").json(b).withColumnRenamed("label", "again"), "n_nationkey")


_P = f"p AS ({PLACES})"
_K = f"known AS (SELECT DISTINCT code AS crs FROM p WHERE n % 10 <> 3 AND odd = '' AND (n % 7 = 0 OR n % 11 <> 0))"
_T = f"""
WITH {_P}, {_K}, k AS ({STOPS}),
trip AS (SELECT DISTINCT number, 'C' || lpad(CAST(number % 997 AS VARCHAR), 5, '0') AS uid FROM k WHERE number % 19 <> 0),
route AS (SELECT n_nationkey AS r, 'A' || (n_nationkey % 4) AS agency FROM nation WHERE n_nationkey % 5 <> 2),
toc AS (SELECT uid, arg_min(agency, number) AS toc FROM trip JOIN route ON r = number % 30 GROUP BY uid),
ends AS (SELECT number, arg_min(code, seq) AS a, arg_max(code, seq) AS z, arg_min(n, seq) AS an, arg_max(n, seq) AS zn FROM k GROUP BY number HAVING count(*) >= 2),
good AS (SELECT * FROM trip JOIN ends USING (number) WHERE number % 11 < 9 AND number % 11 <> 5 AND an % 13 <> 0 AND zn % 13 <> 0),
one AS (SELECT uid, min(number) AS number, arg_min(a, number) AS a, arg_min(z, number) AS z FROM good GROUP BY uid),
built AS (SELECT uid, a AS origin_crs, z AS destination_crs, CAST(((number % 11) * 37 + 11) % 128 AS INTEGER) AS runs_on_days, toc FROM one LEFT JOIN toc USING (uid)
  WHERE a IN (SELECT crs FROM known) AND z IN (SELECT crs FROM known))
"""

LIST = [
    ("gtfs_stops", lambda v: R.stops(v.spark, _stops_file(v)), f"""
     WITH {_P} SELECT code AS stop_id, name AS stop_name, CASE WHEN n % 7 <> 0 THEN n / 10.0 END AS stop_lat, CAST(1.5 AS DOUBLE) AS stop_lon FROM p
     WHERE n % 10 <> 3 AND odd = '' AND (n % 7 = 0 OR n % 11 <> 0)"""),
    ("gtfs_calendar_file", lambda v: R.calendar(v.spark, _calendar_file(v)), """
     SELECT DISTINCT 'S' || (n_nationkey % 9) AS service_id, CAST(((n_nationkey % 9) * 37 + 11) % 128 AS INTEGER) AS mask FROM nation WHERE n_nationkey % 9 <> 5"""),
    ("gtfs_agency_routes", lambda v: R.routes(v.spark, _routes_file(v)).join(R.agencies(v.spark, _agency_file(v)), "agency_id"), """
     WITH a AS (SELECT 'A' || (n_nationkey % 6) AS agency_id, arg_max(n_name, n_nationkey) AS agency_name FROM nation WHERE n_nationkey % 6 <> 5 GROUP BY 1)
     SELECT agency_id, 'R' || n_nationkey AS route_id, agency_name FROM nation JOIN a ON agency_id = 'A' || (n_nationkey % 4) WHERE n_nationkey % 5 <> 2"""),
    ("gtfs_trips_stop_times", lambda v: R.stop_times(v.spark, _times_file(v)).select(F.right("trip_id", F.lit(15)).alias("rid"), "position", "crs", "dep_secs", "arr_secs"), f"""
     WITH k AS ({STOPS}) SELECT rid, seq AS position, CASE WHEN n % 13 <> 0 THEN code END AS crs, CAST(hour(sched_dep) * 3600 + minute(sched_dep) * 60 AS INTEGER) AS dep_secs,
       CASE WHEN seq <> 3 THEN CAST(hour(sched_arr) * 3600 + minute(sched_arr) * 60 AS INTEGER) END AS arr_secs FROM k"""),
    ("gtfs_services_from_files", lambda v: _built(v)[2], _T + "SELECT * FROM built"),
    ("gtfs_timetable_from_files", _timetable, _T + """,
     x AS (SELECT DISTINCT uid, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS operating_date, code, seq, CAST(hour(sched_dep) * 3600 + minute(sched_dep) * 60 AS INTEGER) AS dep,
       CASE WHEN seq <> 3 THEN CAST(hour(sched_arr) * 3600 + minute(sched_arr) * 60 AS INTEGER) END AS arr
       FROM built JOIN trip USING (uid) JOIN k USING (number), range(7) r(i) WHERE (runs_on_days >> CAST(i AS INTEGER)) & 1 = 1 AND n % 13 <> 0 AND code IN (SELECT crs FROM known))
     SELECT uid, operating_date, count(*) AS n_calls, min(dep) AS first_dep, CAST(sum(seq) AS BIGINT) AS orders, count(arr) AS arrivals FROM x GROUP BY 1, 2"""),
    ("ref_coords_csv", lambda v: R.station_coords(v.spark, _coords_file(v)), f"""
     WITH {_P} SELECT lpad(CAST(n % 60 AS VARCHAR), 4, '0') AS nlc, arg_max(n / 8.0, n) AS lon, arg_max(50 + n / 16.0, n) AS lat FROM p WHERE n % 5 <> 0 GROUP BY 1"""),
    ("ref_station_csv", lambda v: R.station_master(v.spark, _stations_file(v), R.station_coords(v.spark, _coords_file(v))), f"""
     WITH {_P}, c AS (SELECT n % 60 AS nlc, arg_max(n / 8.0, n) AS lon, arg_max(50 + n / 16.0, n) AS lat FROM p WHERE n % 5 <> 0 GROUP BY 1),
     f AS (SELECT {_letters("n % 70")} AS crs, arg_min(name, n) AS name, min(n) AS n FROM p WHERE n % 9 <> 0 GROUP BY 1)
     SELECT crs, name, lpad(CAST(n % 80 AS VARCHAR), 4, '0') AS nlc, lat, lon FROM f LEFT JOIN c ON nlc = n % 80"""),
    ("ref_operator_csv", lambda v: R.operator_master(v.spark, _operators_file(v)), f"""
     WITH {_P} SELECT 'T' || (n % 30) AS toc, arg_min(name, n) AS name FROM p WHERE n % 8 <> 0 AND n % 6 <> 0 GROUP BY 1"""),
    ("ref_catalog_csv", lambda v: R.catalog(v.spark, _catalog_file(v), 7, 8), """
     SELECT 'K' || o_orderkey AS code, 'name' AS name, CAST(o_orderdate AS DATE) AS valid_from,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL '90' DAY AS DATE) END AS valid_to FROM orders"""),
    ("history_json_to_observations", _history, f"""
     WITH {_P}, k AS ({STOPS}), d AS (SELECT number, CAST(min(sched_dep) AS DATE) AS day FROM k GROUP BY number),
     x AS (SELECT *, hour(sched_dep) * 60 + minute(sched_dep) AS due, (hour(sched_dep) * 60 + minute(sched_dep) + number % 1000) % 1440 AS gone FROM k JOIN d USING (number)
       WHERE number % 5 > 0 AND seq % 4 <> 3 AND n % 10 <> 3 AND code IN (SELECT code FROM p WHERE n % 10 <> 3)),
     y AS (SELECT *, CASE WHEN gone - due < -120 THEN gone - due + 1440 WHEN gone - due > 720 THEN gone - due - 1440 ELSE gone - due END AS delay FROM x)
     SELECT right(rid, 7) AS uid, code AS origin_crs, {{WD:day}} AS weekday, CAST(hour(sched_dep) AS INTEGER) AS departure_hour, CAST(delay AS INTEGER) AS delay_mins,
       strftime(day + to_minutes(CAST(due AS INTEGER)), '%Y-%m-%d %H:%M') AS recorded_at FROM y WHERE delay BETWEEN -120 AND 600"""),
    ("osm_station_json", _map_stations, f"""
     WITH {_P}, s AS (SELECT n, {_letters("n % 70")} AS crs, CASE WHEN n % 4 = 0 THEN name WHEN n % 4 = 1 THEN 'Old ' || name END AS name, CASE WHEN n % 3 = 0 THEN 'T' || n END AS tiploc
       FROM p WHERE n % 9 <> 0 AND n % 4 < 2)
     SELECT crs, arg_min(name, n) AS name, CAST(min(n) AS DOUBLE) AS lat, CAST(1 AS DOUBLE) AS lon, arg_min(tiploc, n) FILTER (tiploc IS NOT NULL) AS tiploc FROM s GROUP BY crs"""),
    ("location_reference", _locations, """
     WITH c AS (SELECT c_custkey AS n, 48.0 + (c_custkey % 1300) / 100.0 AS lat, -9.0 + (c_custkey % 1100) / 100.0 AS lon FROM customer)
     SELECT 'T' || (n % 400) AS tiploc, arg_min(CAST(lat AS DOUBLE), n) AS lat, arg_min(CAST(lon AS DOUBLE), n) AS lon FROM c WHERE lat BETWEEN 49 AND 61 AND lon BETWEEN -8.5 AND 2 AND lon <> 0 GROUP BY 1"""),
    ("weather_hourly", _weather, "SELECT strftime(hour, '%Y-%m-%d %H:%M') AS hour, CAST(CASE WHEN wind % 7 > 0 THEN wind ELSE 0 END AS DOUBLE) AS wind FROM weather_hourly"),
    ("sink_history_idempotent", _history_sink, """
     WITH o AS (SELECT *, CAST(recorded_at AS DATE) AS day, obs_id % 2 AS wave FROM observations)
     SELECT arg_min(obs_id, (wave, obs_id)) AS obs_id, arg_min(delay_mins, (wave, obs_id)) AS delay_mins FROM o GROUP BY uid, weekday, origin_crs, departure_hour, day"""),
    ("sink_journeys_once", _journey_sink, "SELECT rid, count(*) AS n, count(DISTINCT seq) AS seqs FROM journey_calls GROUP BY rid"),
    ("replace_generation", _replaced, """
     SELECT 'g' || (obs_id % 2) AS generation, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS total FROM observations WHERE obs_id % 2 = 0 OR obs_id % 3 = 0 GROUP BY 1"""),
    ("export_files", _exported, """
     SELECT n_nationkey, 'say "' || n_name || '", twice' AS label, 'say "' || n_name || '", twice' AS again FROM nation"""),
]
