"""State, upkeep and scalar-rule queries: (name, query over the views, DuckDB SQL over the same views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuo.functions import scalars as S
from punctuo.operators import links as L
from punctuo.operators import states as T

C = F.col
#: Conditions on a number of the train, standing in for facts that the given tables lack.
NUMBER = "CAST(rid AS BIGINT)"


def _latest(v):
    return v.sql("SELECT max(recorded_at) AS t FROM observations").first()["t"]


def _hhmm(name):
    return F.date_format(name, "HHmm")


LIST = [
    ("history_scan", lambda v: T.history_scan(v.observations, "2024-01-02", ["2024-01-03"], -30, 60).select("obs_id"), """
     SELECT obs_id FROM observations WHERE recorded_at >= TIMESTAMP '2024-01-02' AND delay_mins BETWEEN -30 AND 60
       AND CAST(recorded_at AS DATE) <> DATE '2024-01-03'"""),
    ("retention_prune", lambda v: T.retention_counts(v.timetable_calls, "operating_date", "1997-06-01", 7), """
     SELECT count(*) FILTER (operating_date >= DATE '1997-05-25') AS kept,
       count(*) FILTER (operating_date < DATE '1997-05-25') AS removed FROM timetable_calls"""),
    ("key_lookup", lambda v: v.journey_calls.join(v.outcomes.filter("prediction_confidence >= 0.9"), "rid", "left_semi").select("rid", "seq", "tpl"), """
     SELECT rid, seq, tpl FROM journey_calls WHERE rid IN (SELECT rid FROM outcomes WHERE prediction_confidence >= 0.9)"""),
    ("todays_calls", lambda v: T.todays_calls(v.timetable_calls, "1997-06-02 08:00:00"), """
     SELECT * FROM timetable_calls WHERE operating_date = DATE '1997-06-02' AND dep_secs > 28800"""),
    ("timetable_departures", lambda v: T.timetable_departures(v.timetable_calls), """
     SELECT location_crs, operating_date, trip_id, call_order, CAST(row_number() OVER (PARTITION BY location_crs, operating_date
       ORDER BY dep_secs NULLS LAST, trip_id, call_order) AS INTEGER) AS place FROM timetable_calls"""),
    ("latlon_or_drop", lambda v: T.located_ends(v.journey_calls, v.stations), """
     WITH e AS (SELECT rid, arg_min(tpl, seq) AS origin, arg_max(tpl, seq) AS destination FROM journey_calls GROUP BY rid)
     SELECT rid, origin, CAST(a.lat AS DOUBLE) AS origin_lat, CAST(a.lon AS DOUBLE) AS origin_lon, destination,
       CAST(b.lat AS DOUBLE) AS destination_lat, CAST(b.lon AS DOUBLE) AS destination_lon
     FROM e JOIN stations a ON a.tpl = origin JOIN stations b ON b.tpl = destination WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL"""),
    ("semi_known_refs", lambda v: v.observations.join(v.services, "uid", "left_semi").select("obs_id", "uid"),
     "SELECT obs_id, uid FROM observations WHERE uid IN (SELECT uid FROM services)"),
    ("wind_incident_flag", lambda v: T.wind_incident(v.observations, v.weather_hourly), """
     SELECT obs_id, coalesce(wind, 0) AS wind, coalesce(wind, 0) > 50 AS incident
     FROM observations LEFT JOIN weather_hourly ON hour = date_trunc('hour', recorded_at)"""),
    ("network_summary", lambda v: T.network_summary(v.journeys), """
     SELECT count(*) AS tracked, count(*) FILTER (arrival_delay_mins > 0) AS late, count(*) FILTER (arrival_delay_mins <= 0) AS on_time,
       max(arrival_delay_mins) AS worst FROM journeys"""),
    ("rolling_stats_serving", lambda v: T.rolling_serving(v.observations, ["uid", "origin_crs"], _latest(v)), """
     WITH d AS (SELECT CAST(date_trunc('day', max(recorded_at)) AS TIMESTAMP) AS day FROM observations),
     o AS (SELECT uid, origin_crs, delay_mins AS m, CASE WHEN recorded_at >= day - INTERVAL '7' DAY THEN delay_mins END AS w
       FROM observations, d WHERE recorded_at < day AND recorded_at >= day - INTERVAL '14' DAY),
     g AS (SELECT uid, origin_crs, count(w) AS n, avg(w) AS mean_7, stddev_pop(w) AS std_7, avg(CASE WHEN w <= 0 THEN 1e0 WHEN w > 0 THEN 0e0 END)
       AS on_time_7, ln(1 + count(w)) AS log_n_7, avg(m) AS mean_14, stddev_pop(m) AS std_14,
       avg(CASE WHEN m <= 0 THEN 1e0 WHEN m > 0 THEN 0e0 END) AS on_time_14, ln(1 + count(m)) AS log_n_14 FROM o GROUP BY 1, 2)
     SELECT uid, origin_crs, CASE WHEN n > 0 THEN mean_7 ELSE 0e0 END AS mean_7, CASE WHEN n > 0 THEN std_7 ELSE 0e0 END AS std_7,
       CASE WHEN n > 0 THEN on_time_7 ELSE 0e0 END AS on_time_7, CASE WHEN n > 0 THEN log_n_7 ELSE 0e0 END AS log_n_7,
       CASE WHEN n > 0 THEN mean_14 ELSE 0e0 END AS mean_14, CASE WHEN n > 0 THEN std_14 ELSE 0e0 END AS std_14,
       CASE WHEN n > 0 THEN on_time_14 ELSE 0e0 END AS on_time_14, CASE WHEN n > 0 THEN log_n_14 ELSE 0e0 END AS log_n_14 FROM g"""),
    ("mean_recent_delay_serving", lambda v: T.recent_mean_of_others(v.observations, ["origin_crs"], _latest(v), 720, 1), """
     WITH r AS (SELECT * FROM observations WHERE recorded_at >= (SELECT max(recorded_at) FROM observations) - INTERVAL '12' HOUR),
     w AS (SELECT obs_id, delay_mins AS d, sum(delay_mins) OVER (PARTITION BY origin_crs) AS s, count(delay_mins) OVER (PARTITION BY origin_crs) AS n FROM r)
     SELECT obs_id, CASE WHEN n > 1 THEN (s - d) / (n - 1e0) ELSE 0e0 END AS mean_others FROM w"""),
    ("stop_first_seen_seq", lambda v: T.first_seen_order(v.journey_calls), """
     WITH s AS (SELECT rid, tpl, min(seq) AS f FROM journey_calls GROUP BY 1, 2)
     SELECT rid, tpl, CAST(dense_rank() OVER (PARTITION BY rid ORDER BY f) AS INTEGER) AS place FROM s"""),
    ("tracking_board", lambda v: T.tracking_board(v.outcomes, "1997-06-02 08:00:00"), """
     SELECT rid, scheduled_departure, predicted_delay_mins FROM outcomes WHERE scheduled_departure >= TIMESTAMP '1997-06-02 07:55:00'
       AND predicted_delay_mins IS NOT NULL ORDER BY scheduled_departure, rid LIMIT 24"""),
    ("fit_encodings", lambda v: T.encodings(v.observations, "origin_crs"), """
     SELECT origin_crs, CAST(row_number() OVER (ORDER BY origin_crs) AS INTEGER) AS code FROM (SELECT DISTINCT origin_crs FROM observations) x"""),
    ("apply_encodings", lambda v: T.encode(v.observations, T.encodings(v.observations.filter("weekday < 5"), "uid"), "uid").select("obs_id", "code"), """
     WITH c AS (SELECT uid, row_number() OVER (ORDER BY uid) AS code FROM (SELECT DISTINCT uid FROM observations WHERE weekday < 5) x)
     SELECT obs_id, CAST(coalesce(code, 0) AS INTEGER) AS code FROM observations LEFT JOIN c USING (uid)"""),
    ("feed_freshness", lambda v: T.freshness(v.observations, "origin_crs", "recorded_at", _latest(v)), """
     WITH g AS (SELECT origin_crs, CAST(floor(epoch((SELECT max(recorded_at) FROM observations))) - floor(epoch(max(recorded_at))) AS BIGINT) AS lag_s
       FROM observations GROUP BY 1) SELECT origin_crs, lag_s, CASE WHEN lag_s > 300 THEN 'stale' ELSE 'fresh' END AS state FROM g"""),
    ("source_priority_merge", lambda v: T.highest_version(v.journey_calls, ["rid"], ["arr_delay_mins", "dep_delay_mins"], "seq"), """
     SELECT rid, arg_max(arr_delay_mins, seq) AS arr_delay_mins, arg_max(dep_delay_mins, seq) FILTER (dep_delay_mins IS NOT NULL) AS dep_delay_mins
     FROM journey_calls GROUP BY rid"""),
    ("merge_calls", lambda v: T.highest_version(v.journey_calls, ["rid", "tpl"], ["actual_dep", "actual_arr"], "seq"), """
     SELECT rid, tpl, arg_max(actual_dep, seq) FILTER (actual_dep IS NOT NULL) AS actual_dep, arg_max(actual_arr, seq) AS actual_arr
     FROM journey_calls GROUP BY rid, tpl"""),
    ("build_journey", lambda v: T.build_journey(v.journey_calls), """
     WITH k AS (SELECT *, max(seq) OVER (PARTITION BY rid) AS z, coalesce(dep_delay_mins, arr_delay_mins) AS d FROM journey_calls),
     g AS (SELECT rid, count(*) AS n_calls, max(CASE WHEN seq = 0 THEN dep_delay_mins END) AS origin_delay, max(CASE WHEN seq = z THEN arr_delay_mins END)
       AS arrival_delay, max(d) AS max_delay, min(d) AS min_delay, count(*) FILTER (is_cancelled) AS n_cancelled FROM k GROUP BY rid)
     SELECT *, max_delay - arrival_delay AS recovered, n_cancelled = n_calls AS cancelled, n_cancelled > 0 AND n_cancelled < n_calls AS partly FROM g"""),
    ("origin_delay_live", lambda v: T.origin_delay(v.journey_calls), """
     SELECT rid, CAST(date_diff('minute', sched_dep, coalesce(actual_dep, actual_arr)) AS INTEGER) AS mins FROM journey_calls WHERE seq = 0"""),
    ("evict_departed", lambda v: T.evict_departed(v.outcomes, "1997-06-02 08:00:00", C("finalised_at"), C("scheduled_departure")).select("rid"), """
     SELECT rid FROM outcomes WHERE least(finalised_at, scheduled_departure + INTERVAL '6' HOUR) >= TIMESTAMP '1997-06-02 07:55:00'"""),
    ("sink_finalise", lambda v: T.finalised(L.first_prediction(v.snapshots), v.outcomes), """
     WITH f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY snapshotted_at, predicted_delay_mins) AS r FROM snapshots)
     SELECT rid, f.predicted_delay_mins, final_delay_mins FROM f JOIN outcomes USING (rid) WHERE r = 1 AND final_delay_mins IS NOT NULL"""),
    ("sink_cancellation", lambda v: T.cancellations(v.journey_calls), """
     SELECT rid, tpl, {WD:sched_dep} AS weekday, CAST(hour(sched_dep) AS INTEGER) AS hour FROM (SELECT *, row_number() OVER (PARTITION BY rid
       ORDER BY seq) AS r FROM journey_calls WHERE is_cancelled) x WHERE r = 1"""),
    ("gtfs_calendar_mask", lambda v: T.calendar_mask(v.observations, "uid", "weekday"),
     "SELECT uid, CAST(bit_or(1 << weekday) AS INTEGER) AS mask FROM observations GROUP BY uid"),
    ("hist_wrapped_delay", lambda v: v.journey_calls.select("rid", "seq", S.hist_wrapped_delay(_hhmm("sched_dep"), _hhmm("actual_dep")).alias("mins")), """
     SELECT rid, seq, CAST(CASE WHEN g < -120 THEN g + 1440 WHEN g > 720 THEN g - 1440 ELSE g END AS INTEGER) AS mins FROM (SELECT rid, seq,
       hour(actual_dep) * 60 + minute(actual_dep) - hour(sched_dep) * 60 - minute(sched_dep) AS g FROM journey_calls) x"""),
    ("clock_parse", lambda v: v.journey_calls.select("rid", "seq", S.clock_parse(F.to_date("sched_dep"), F.date_format("sched_dep", "HH:mm")).alias("at")),
     "SELECT rid, seq, date_trunc('minute', sched_dep) AS at FROM journey_calls"),
    ("gtfs_clock", lambda v: v.observations.select("obs_id", S.gtfs_clock(F.concat((C("departure_hour") + 24).cast("string"), F.lit(":05:09"))).alias("secs")),
     "SELECT obs_id, departure_hour * 3600 + 309 AS secs FROM observations"),
    ("stop_code_suffix", lambda v: v.observations.select("obs_id", S.stop_code_suffix(F.concat(F.lit("9100"), F.upper("origin_crs"))).alias("code")),
     "SELECT obs_id, upper(right(origin_crs, 3)) AS code FROM observations"),
    ("uid_from_trip", lambda v: v.observations.select("obs_id", S.uid_from_trip(F.concat("uid", F.lit("_"), C("obs_id").cast("string"))).alias("found")),
     "SELECT obs_id, uid AS found FROM observations"),
    ("id_validity", lambda v: v.outcomes.select("rid", S.valid_rid(C("rid")).alias("good_rid"), S.valid_uid(C("uid")).alias("good_uid"), S.valid_crs(C("origin_crs")).alias("good_crs")), r"""
     SELECT rid, regexp_full_match(rid, '\d{15}') AS good_rid, regexp_full_match(uid, '[A-Z]\d{5}') AS good_uid,
       regexp_full_match(origin_crs, '[A-Z]{3}') AS good_crs FROM outcomes"""),
    ("minutes_until", lambda v: v.outcomes.select("rid", S.minutes_until_serving(C("scheduled_departure"), C("finalised_at")).alias("mins")),
     "SELECT rid, date_diff('second', finalised_at, scheduled_departure) / 60e0 AS mins FROM outcomes"),
    ("wind_level", lambda v: v.weather_hourly.select("hour", S.wind_level_serving(C("wind"), C("wind") % 7 == 0).alias("level")), """
     SELECT hour, CASE WHEN wind > 50 THEN 1 ELSE 0 END + CASE WHEN wind % 7 = 0 THEN 2 ELSE 0 END AS level FROM weather_hourly"""),
    ("blend_preceding", lambda v: v.outcomes.select("rid", S.blend_preceding(C("predicted_delay_mins"), C("final_delay_mins")).alias("mins")), """
     SELECT rid, CAST(CASE WHEN final_delay_mins IS NULL THEN predicted_delay_mins
       ELSE round(0.6e0 * predicted_delay_mins + 0.4e0 * final_delay_mins) END AS INTEGER) AS mins FROM outcomes"""),
    ("reason_class", lambda v: v.outcomes.select("rid", S.reason_class(C("rid").cast("long") % 200).alias("class")), """
     SELECT rid, CASE WHEN CAST(rid AS BIGINT) % 200 IN (163, 166, 168, 148, 171) THEN 1
       WHEN CAST(rid AS BIGINT) % 200 IN (100, 131, 134, 180, 185, 139) THEN 2 ELSE 0 END AS class FROM outcomes"""),
    ("brand_colour", lambda v: v.stations.select("tpl", S.brand_colour(F.concat(F.element_at(F.array(F.lit("LNER "), F.lit("Great Northern "), F.lit("northern "), F.lit("x ")), (F.substring("tpl", 6, 1).cast("int") % 4 + 1)), "name")).alias("colour")), """
     SELECT tpl, ['#ce0e2d', '#1d1d4e', '#262262', '#9aa7b4'][CAST(substr(tpl, 6, 1) AS INTEGER) % 4 + 1] AS colour FROM stations"""),
    ("delay_band", lambda v: v.outcomes.select("rid", S.delay_band_live(C("final_delay_mins")).alias("live"), S.delay_band_edge(C("final_delay_mins")).alias("edge")), """
     SELECT rid, CASE WHEN final_delay_mins >= 6 THEN 'late' WHEN final_delay_mins > 1 THEN 'minor' ELSE 'on_time' END AS live,
       CASE WHEN final_delay_mins > 4 THEN 2 WHEN final_delay_mins > 1 THEN 1 ELSE 0 END AS edge FROM outcomes"""),
    ("best_value", lambda v: v.outcomes.select("rid", F.coalesce("final_delay_mins", "predicted_delay_mins").alias("best")),
     "SELECT rid, coalesce(final_delay_mins, predicted_delay_mins) AS best FROM outcomes"),
    ("labels_format", lambda v: v.observations.select("obs_id", S.weekday_name(C("weekday")).alias("day"), S.hour_label(C("departure_hour")).alias("hour")), """
     SELECT obs_id, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][weekday + 1] AS day,
       lpad(CAST(departure_hour AS VARCHAR), 2, '0') || ':00' AS hour FROM observations"""),
    ("haversine", lambda v: v.stations.select("tpl", S.haversine(C("lat"), C("lon"), F.lit(51.5), F.lit(-0.1)).alias("km")), """
     SELECT tpl, 2 * 6371e0 * asin(sqrt(least(1e0, power(sin(radians(51.5e0 - lat) / 2), 2)
       + cos(radians(lat)) * cos(radians(51.5e0)) * power(sin(radians(-0.1e0 - lon) / 2), 2)))) AS km FROM stations"""),
    ("features_json", lambda v: v.observations.select("obs_id", F.get_json_object(F.to_json(F.struct("delay_mins", "weekday")), "$.delay_mins").cast("int").alias("delay")),
     "SELECT obs_id, delay_mins AS delay FROM observations"),
    ("urgency_state", lambda v: v.outcomes.select("rid", S.urgency_state(F.expr(f"{NUMBER} % 200 - 20"), F.expr(f"{NUMBER} % 11 = 0"), F.expr(f"{NUMBER} % 13 = 0")).alias("state")), """
     SELECT rid, CASE WHEN n % 13 = 0 THEN 'Terminal' WHEN n % 11 = 0 OR n % 200 < 25 THEN 'Critical' WHEN n % 200 <= 50 THEN 'Active'
       WHEN n % 200 <= 140 THEN 'Monitored' ELSE 'Dormant' END AS state FROM (SELECT rid, CAST(rid AS BIGINT) AS n FROM outcomes) x"""),
]
