"""Join, window and feature queries: (name, query over the views, DuckDB SQL over the same views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuo.functions import scalars as S
from punctuo.operators import links as L

PATTERN = ["uid", "weekday", "origin_crs"]
_P = "PARTITION BY uid, weekday, origin_crs"


def _asked(v):
    return v.spark.createDataFrame([("T00001", "T00002"), ("T00003", "T00004"), ("T00005", "T00006")], "from_crs string, to_crs string")


def _upserted(v):
    new = v.operators.filter("toc <> 'R0'").withColumns({"name": F.lower("name"), "brand_color": F.lit(None).cast("string")})
    return L.upsert(v.operators, new, "toc", ["brand_color"])


LIST = [
    ("direct_journeys", lambda v: L.direct_journeys(v.timetable_calls, _asked(v)), """
     SELECT a.location_crs AS from_crs, b.location_crs AS to_crs, a.uid, a.operating_date, a.trip_id, a.dep_secs, b.dep_secs AS arr_secs
     FROM timetable_calls a JOIN timetable_calls b ON a.uid = b.uid AND a.operating_date = b.operating_date
       AND a.trip_id = b.trip_id AND b.call_order > a.call_order
     WHERE (a.location_crs, b.location_crs) IN (('T00001', 'T00002'), ('T00003', 'T00004'), ('T00005', 'T00006'))"""),
    ("convergence_for_rid", lambda v: L.convergence(v.snapshots, v.outcomes), """
     SELECT rid, date_diff('second', snapshotted_at, scheduled_departure) / 60e0 AS lead_mins, s.predicted_delay_mins,
       final_delay_mins, abs(final_delay_mins - s.predicted_delay_mins) AS abs_error
     FROM snapshots s JOIN outcomes USING (rid) WHERE finalised_at IS NOT NULL"""),
    ("cheapest_fare", lambda v: L.cheapest_fare(v.fares, "1997-06-01"), """
     SELECT origin, destination, price_pence, class FROM (SELECT *, row_number() OVER (PARTITION BY origin, destination
       ORDER BY price_pence, class) AS r FROM fares
       WHERE DATE '1997-06-01' BETWEEN valid_from AND coalesce(valid_to, DATE '2999-12-31')) x WHERE r = 1"""),
    ("asof_preceding_train", lambda v: L.asof_preceding(v.observations), """
     SELECT obs_id, CASE WHEN p.u <> uid THEN p.d ELSE 0 END AS preceding_delay FROM (SELECT obs_id, uid,
       max({'t': recorded_at, 'i': obs_id, 'u': uid, 'd': delay_mins}) OVER (PARTITION BY origin_crs
         ORDER BY epoch_us(recorded_at) RANGE BETWEEN 1200000000 PRECEDING AND 1 PRECEDING) AS p FROM observations) x"""),
    ("station_congestion_training", lambda v: L.station_congestion(v.observations), """
     SELECT obs_id, coalesce(avg(delay_mins) OVER (PARTITION BY origin_crs ORDER BY epoch_us(recorded_at)
       RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING), 0) AS congestion FROM observations"""),
    ("operator_cascade_training", lambda v: L.operator_cascade(v.observations), """
     WITH r AS (SELECT obs_id, date_trunc('hour', recorded_at) AS h, substr(uid, 1, 5) AS p, delay_mins FROM observations),
     m AS (SELECT p, h + INTERVAL '1' HOUR AS h, avg(delay_mins) AS m FROM r GROUP BY p, r.h HAVING count(*) >= 3)
     SELECT obs_id, coalesce(m, 0) AS cascade FROM r LEFT JOIN m USING (p, h)"""),
    ("history_ring", lambda v: L.history_ring(v.observations, PATTERN, 20).select("obs_id", "age"), f"""
     SELECT obs_id, age FROM (SELECT obs_id, row_number() OVER ({_P} ORDER BY recorded_at DESC, obs_id DESC) AS age
       FROM observations) x WHERE age <= 20"""),
    ("trimmed_mean_predict", lambda v: L.trimmed_mean(v.observations, PATTERN, 20), f"""
     WITH g AS (SELECT *, row_number() OVER ({_P} ORDER BY recorded_at DESC, obs_id DESC) AS age FROM observations),
     h AS (SELECT *, count(*) OVER ({_P}) AS n, row_number() OVER ({_P} ORDER BY delay_mins, obs_id) AS r FROM g WHERE age <= 20),
     k AS (SELECT *, least(n // 10, (n - 1) // 2) AS t FROM h WHERE n >= 3)
     SELECT uid, weekday, origin_crs, CAST(trunc(sum(delay_mins) / count(*)) AS INTEGER) AS predicted, max(n) / 20e0 AS confidence
     FROM k WHERE r > t AND r <= n - t GROUP BY 1, 2, 3"""),
    ("history_ring_90", lambda v: L.history_ring(v.observations, PATTERN, 90).select("obs_id", "age"), f"""
     SELECT obs_id, age FROM (SELECT obs_id, row_number() OVER ({_P} ORDER BY recorded_at DESC, obs_id DESC) AS age
       FROM observations) x WHERE age <= 90"""),
    ("trimmed_mean_predict_90", lambda v: L.trimmed_mean(v.observations, PATTERN, 90), f"""
     WITH g AS (SELECT *, row_number() OVER ({_P} ORDER BY recorded_at DESC, obs_id DESC) AS age FROM observations),
     h AS (SELECT *, count(*) OVER ({_P}) AS n, row_number() OVER ({_P} ORDER BY delay_mins, obs_id) AS r FROM g WHERE age <= 90),
     k AS (SELECT *, least(n // 10, (n - 1) // 2) AS t FROM h WHERE n >= 3)
     SELECT uid, weekday, origin_crs, CAST(trunc(sum(delay_mins) / count(*)) AS INTEGER) AS predicted, max(n) / 90e0 AS confidence
     FROM k WHERE r > t AND r <= n - t GROUP BY 1, 2, 3"""),
    ("rolling_stats_training", lambda v: L.rolling_training(v.observations, ["uid", "origin_crs"], 7), """
     WITH x AS (SELECT a.obs_id, count(b.obs_id) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '7' DAY) AS n,
       avg(b.delay_mins) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '7' DAY) AS m,
       stddev_pop(b.delay_mins) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '7' DAY) AS s,
       avg(CASE WHEN b.delay_mins <= 0 THEN 100e0 ELSE 0e0 END) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '7' DAY) AS o,
       avg(b.delay_mins) AS m14, stddev_pop(b.delay_mins) AS s14
       FROM observations a LEFT JOIN observations b ON a.uid = b.uid AND a.origin_crs = b.origin_crs
         AND b.recorded_at >= a.recorded_at - INTERVAL '14' DAY AND b.recorded_at < date_trunc('day', a.recorded_at)
       GROUP BY a.obs_id) SELECT obs_id, n, coalesce(m, 0) AS mean, coalesce(s, 0) AS std, coalesce(o, 0) AS on_time,
       ln(1 + n) AS log_n, coalesce(m14, 0) AS mean_14, coalesce(s14, 0) AS std_14 FROM x"""),
    ("journey_final_label", lambda v: L.final_label(v.observations, PATTERN), f"""
     SELECT obs_id, first(delay_mins) OVER w AS label, row_number() OVER w = 1 AS is_final FROM observations
     WINDOW w AS ({_P}, CAST(recorded_at AS DATE) ORDER BY recorded_at DESC, obs_id DESC)"""),
    ("edge_stats", lambda v: L.edge_stats(v.journey_calls, v.stations, 400.0), """
     WITH c AS (SELECT rid, seq, tpl, lat, lon, arr_delay_mins FROM journey_calls JOIN stations USING (tpl) WHERE lat IS NOT NULL),
     p AS (SELECT *, lead(tpl) OVER w AS nt, lead(lat) OVER w AS nla, lead(lon) OVER w AS nlo, lead(arr_delay_mins) OVER w AS nd
       FROM c WINDOW w AS (PARTITION BY rid ORDER BY seq))
     SELECT least(tpl, nt) AS a, greatest(tpl, nt) AS b, avg(nd) AS mean_delay, least(count(*), 999) AS n,
       CASE WHEN avg(nd) <= 1 THEN 0 WHEN avg(nd) <= 4 THEN 1 ELSE 2 END AS band
     FROM p WHERE nt IS NOT NULL AND nt <> tpl AND sqrt(power((nlo - lon) * 67, 2) + power((nla - lat) * 111, 2)) < 400
     GROUP BY 1, 2 HAVING count(*) >= 2"""),
    ("weather_join", lambda v: L.weather_join(v.observations, v.weather_hourly), """
     SELECT obs_id, coalesce(wind, 0) AS wind, CASE WHEN coalesce(wind, 0) < 20 THEN 0 WHEN wind < 35 THEN 1
       WHEN wind < 50 THEN 2 ELSE 3 END AS wind_level
     FROM observations LEFT JOIN weather_hourly ON hour = date_trunc('hour', recorded_at)"""),
    ("sink_first_prediction", lambda v: L.first_prediction(v.snapshots), """
     SELECT rid, predicted_delay_mins FROM (SELECT *, row_number() OVER (PARTITION BY rid
       ORDER BY snapshotted_at, predicted_delay_mins) AS r FROM snapshots) x WHERE r = 1"""),
    ("upsert_dim", _upserted, """
     SELECT toc, CASE WHEN toc <> 'R0' THEN lower(name) ELSE name END AS name, brand_color FROM operators"""),
    ("temporal_split", lambda v: L.temporal_split(v.observations), """
     WITH d AS (SELECT DISTINCT CAST(recorded_at AS DATE) AS day FROM observations),
     r AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS b, count(*) OVER () AS t FROM d)
     SELECT day, CASE WHEN b <= greatest(1, round_even(t * 0.2, 0)) THEN 'later' ELSE 'earlier' END AS part FROM r"""),
    ("tier_weights", lambda v: L.tier_weights(v.observations), """
     WITH c AS (SELECT CASE WHEN delay_mins <= 0 THEN 0 WHEN delay_mins <= 5 THEN 1 WHEN delay_mins <= 30 THEN 2 ELSE 3 END
       AS tier, count(*) AS n FROM observations GROUP BY 1)
     SELECT tier, n, sum(n) OVER () / (count(*) OVER () * n * 1e0) AS weight FROM c"""),
    ("wrapped_delay", lambda v: v.journey_calls.select("rid", "seq", S.wrapped_delay(F.col("sched_dep"), F.col("actual_dep")).alias("mins")),
     "SELECT rid, seq, dep_delay_mins AS mins FROM journey_calls"),
    ("confidence_decay", lambda v: v.outcomes.filter("prediction_confidence is not null").select("rid", S.confidence_decay(F.col("prediction_confidence"), F.col("rid").cast("long") % 60).alias("c")), """
     SELECT rid, CASE WHEN CAST(rid AS BIGINT) % 60 > 21 THEN prediction_confidence * exp(-(CAST(rid AS BIGINT) % 60) / 21e0)
       ELSE prediction_confidence END AS c FROM outcomes WHERE prediction_confidence IS NOT NULL"""),
    ("peak_flag", lambda v: v.observations.select("obs_id", S.peak_flag(F.col("departure_hour"), F.col("weekday")).alias("peak")),
     "SELECT obs_id, CAST(departure_hour IN (7, 8, 16, 17, 18) AND weekday < 5 AS INTEGER) AS peak FROM observations"),
]
