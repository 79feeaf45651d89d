"""Feed, board and timetable queries: (name, query over the views, DuckDB SQL over the same views).

The given tables hold no feed, so its messages are written, by Spark, from the calls of trains and decoded again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuo.operators import live as B
from punctuo.sources import feed

C = F.col


def _clock(c):
    return F.date_format(c, "HH:mm")


def _messages(v, cut_every: int = 0):
    """A status message of every train; with ``cut_every`` some are cut off in the middle."""
    dep = F.when(C("actual_dep").isNotNull(), F.concat(F.lit('<ns2:dep at="'), _clock("actual_dep"), F.lit('"/>'))).otherwise("")
    stop = F.concat(
        F.lit('<ns2:Location tpl="'), "tpl", F.lit('" wta="'), _clock("sched_arr"), F.lit('" ptd="'), _clock("sched_dep"), F.lit('"'),
        F.when(C("is_cancelled"), ' can="true"').otherwise(""), F.lit(">"), dep, F.lit("<ns2:plat>"), (C("seq") + 1).cast("string"),
        F.lit("</ns2:plat></ns2:Location>"),
    )
    number = C("rid").cast("long")
    reason = F.when(number % 3 == 0, F.concat(F.lit("<ns2:LateReason>"), (number % 200).cast("string"), F.lit("</ns2:LateReason>")))
    reason = reason.when(number % 3 == 1, F.concat(F.lit('<ns2:LateReason code="'), (number % 200).cast("string"), F.lit('"/>'))).otherwise("")
    trains = v.journey_calls.groupBy("rid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", stop.alias("stop")))), lambda x: x["stop"]), "").alias("stops"),
        F.min("sched_dep").alias("start"),
    )
    value = F.concat(
        F.lit('<?xml version="1.0"?><Pport xmlns:ns2="x" ts="'), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('.0+00:00"><uR><TS rid="'),
        "rid", F.lit('" uid="C12345" ssd="'), F.date_format("start", "yyyy-MM-dd"), F.lit('">'), reason, "stops", F.lit("</TS></uR></Pport>"),
    )
    if cut_every:
        value = F.when(number % cut_every == 0, F.substring(value, 1, 150)).otherwise(value)
    return feed.decoded(trains.select(value.alias("value")))


def _wrapped(body):
    return F.concat(F.lit('<Pport ts="2024-04-17T12:00:00"><uR>'), *body, F.lit("</uR></Pport>")).alias("value")


def _pairs(v):
    return v.sql("SELECT rid AS prev_rid, lead(rid) OVER (PARTITION BY uid ORDER BY rid) AS next_rid FROM outcomes").dropna()


def _timetable(v):
    return v.sql("SELECT tpl AS place, rid AS trip_id, seq AS call_order, sched_dep AS departure FROM journey_calls WHERE seq < 2 AND tpl <> 'T00001'")


def _stops(v):
    return v.journey_calls.select(C("rid").alias("trip_id"), "seq", C("tpl").alias("place"))


def _known(v):
    return v.stations.filter("lat is not null").select("tpl")


LIST = [
    ("feed_decode_status", lambda v: feed.status(_messages(v)).select("rid", "uid", "ssd", _clock("sched_dep").alias("dep"), "platform", "origin_tpl", "dest_tpl", "n_calls"), """
     SELECT rid, 'C12345' AS uid, CAST(min(sched_dep) AS DATE) AS ssd, strftime(min(sched_dep), '%H:%M') AS dep, '1' AS platform,
       arg_min(tpl, seq) AS origin_tpl, arg_max(tpl, seq) AS dest_tpl, CAST(count(*) AS INTEGER) AS n_calls FROM journey_calls GROUP BY rid"""),
    ("feed_decode_calls", lambda v: feed.calls(_messages(v)).select("rid", "seq", "tpl", _clock("sched_arr").alias("arr"), _clock("sched_dep").alias("dep"), _clock("act_dep").alias("actual"), "platform", "is_cancelled"), """
     SELECT rid, seq, tpl, strftime(sched_arr, '%H:%M') AS arr, strftime(sched_dep, '%H:%M') AS dep, strftime(actual_dep, '%H:%M') AS actual,
       CAST(seq + 1 AS VARCHAR) AS platform, is_cancelled FROM journey_calls"""),
    ("feed_decode_reasons", lambda v: feed.reasons(_messages(v)).select("rid", "late_code"), """
     SELECT DISTINCT rid, CAST(CAST(rid AS BIGINT) % 200 AS INTEGER) AS late_code FROM journey_calls WHERE CAST(rid AS BIGINT) % 3 < 2"""),
    ("feed_decode_deactivated", lambda v: feed.deactivated(feed.decoded(v.outcomes.filter("finalised_at is not null").select(_wrapped([F.lit('<deactivated rid="'), "rid", F.lit('"/>')])))).select("rid"),
     "SELECT rid FROM outcomes WHERE finalised_at IS NOT NULL"),
    ("feed_decode_association", lambda v: feed.associations(feed.decoded(_pairs(v).select(_wrapped([
        F.when(C("prev_rid").cast("long") % 4 == 0, '<Association category="VV">').otherwise('<Association tiploc="LEEDS" category="NP">'),
        F.lit('<main rid="'), "prev_rid", F.lit('"/><assoc rid="'), "next_rid", F.lit('"/></Association>')])))).select("prev_rid", "next_rid"), """
     SELECT * FROM (SELECT rid AS prev_rid, lead(rid) OVER (PARTITION BY uid ORDER BY rid) AS next_rid FROM outcomes) x
     WHERE next_rid IS NOT NULL AND CAST(prev_rid AS BIGINT) % 4 <> 0"""),
    ("ingest_counters", lambda v: feed.counters(_messages(v, 7)), """
     SELECT CASE WHEN CAST(rid AS BIGINT) % 7 = 0 THEN 'parse_error' ELSE 'applied' END AS fate, count(*) AS n
     FROM (SELECT DISTINCT rid FROM journey_calls) x GROUP BY 1"""),
    ("sequence_guard", lambda v: feed.in_sequence(v.journey_calls.filter("actual_arr is not null"), "rid", "actual_arr", "seq").select("rid", "seq"), """
     SELECT rid, seq FROM (SELECT rid, seq, actual_arr, max(actual_arr) OVER (PARTITION BY rid ORDER BY seq
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM journey_calls WHERE actual_arr IS NOT NULL) x
     WHERE t IS NULL OR actual_arr > t"""),
    ("state_events", lambda v: feed.state_events(v.journey_calls.filter("seq = 0").withColumn("delay_mins", C("dep_delay_mins"))), """
     SELECT rid, 'Active' AS from_state, 'Critical' AS to_state FROM journey_calls WHERE seq = 0 AND (is_cancelled OR dep_delay_mins > 0)"""),
    ("route_filter", lambda v: B.route_filter(v.journey_calls, ["T00001", "T00007"]),
     "SELECT DISTINCT rid FROM journey_calls WHERE tpl IN ('T00001', 'T00007')"),
    ("turnround_predecessor", lambda v: B.turnround_delay(_pairs(v).withColumn("seen_at", C("prev_rid")), v.journeys.select("rid", C("origin_delay_mins").alias("delay_mins"))), """
     SELECT next_rid, prev_rid, origin_delay_mins AS delay_mins
     FROM (SELECT rid AS prev_rid, lead(rid) OVER (PARTITION BY uid ORDER BY rid) AS next_rid FROM outcomes) x
     LEFT JOIN journeys ON rid = prev_rid WHERE next_rid IS NOT NULL"""),
    ("dest_name_resolve", lambda v: B.resolved_names(v.services.select("uid", C("destination_crs").alias("code")).unionByName(v.journey_calls.select(C("rid").alias("uid"), C("tpl").alias("code"))), "code",
        v.services.select("destination_crs", F.concat(F.lit("To "), "destination_crs")).distinct(), v.stations.filter("lat is not null").select("tpl", "name")), """
     SELECT uid, code, CASE WHEN length(code) = 3 THEN 'To ' || code ELSE name END AS name
     FROM (SELECT uid, destination_crs AS code FROM services UNION ALL SELECT rid, tpl FROM journey_calls) x
     LEFT JOIN stations ON tpl = code AND lat IS NOT NULL"""),
    ("live_departures", lambda v: B.live_departures(v.journey_calls),
     "SELECT upper(tpl) AS place, rid, sched_dep AS departure, dep_delay_mins AS delay_mins FROM journey_calls WHERE seq = 0 AND sched_dep IS NOT NULL"),
    ("departure_board", lambda v: B.departure_board(_timetable(v), B.live_departures(v.journey_calls)).filter("planned"), """
     WITH t AS (SELECT tpl AS place, rid AS trip_id, seq AS call_order, sched_dep AS departure FROM journey_calls WHERE seq < 2 AND tpl <> 'T00001'),
     l AS (SELECT tpl AS place, rid, sched_dep AS live_at, dep_delay_mins AS d FROM journey_calls WHERE seq = 0),
     m AS (SELECT t.*, l.rid, l.d, row_number() OVER (PARTITION BY t.place, trip_id, call_order, departure ORDER BY live_at, l.rid) AS r
       FROM t LEFT JOIN l ON l.place = t.place AND abs(date_diff('second', live_at, departure)) <= 120)
     SELECT place, departure, trip_id, call_order, rid, d AS delay_mins, TRUE AS planned FROM m WHERE r = 1"""),
    ("board_union_fallback", lambda v: B.departure_board(_timetable(v), B.live_departures(v.journey_calls)).filter("not planned").select("place", "departure", "rid", "delay_mins"), """
     SELECT tpl AS place, sched_dep AS departure, rid, dep_delay_mins AS delay_mins FROM journey_calls WHERE seq = 0
       AND tpl NOT IN (SELECT tpl FROM journey_calls WHERE seq < 2 AND tpl <> 'T00001')"""),
    ("name_search_join", lambda v: B.search_names(v.nation.select(F.concat(F.lit("ha "), C("n_nationkey").cast("string")).alias("query")), v.stations.select(C("tpl").alias("code"), "name"), 5), """
     SELECT * FROM (SELECT 'ha ' || n_nationkey AS query, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY length(name), name, tpl)
       AS INTEGER) AS place, tpl AS code, name FROM nation JOIN stations ON split_part(name, ' ', 2) LIKE n_nationkey || '%') x WHERE place <= 5"""),
    ("outcome_journey_replay", lambda v: B.replay(v.outcomes, v.journeys, "1996-01-01", "1996-12-31"), """
     SELECT o.rid, o.scheduled_departure, predicted_delay_mins, final_delay_mins, n_calls FROM outcomes o JOIN journeys j USING (rid)
     WHERE CAST(o.scheduled_departure AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND final_delay_mins IS NOT NULL"""),
    ("gtfs_uid_operator", lambda v: B.operator_of_uid(v.journeys.select("uid", "toc", C("rid").alias("order"))),
     "SELECT uid, arg_min(toc, rid) AS toc FROM journeys WHERE toc IS NOT NULL GROUP BY uid"),
    ("gtfs_build_services", lambda v: B.build_services(v.outcomes.select("uid", C("rid").alias("trip_id")), _stops(v), _known(v)), """
     WITH e AS (SELECT rid, arg_min(tpl, seq) AS origin, arg_max(tpl, seq) AS destination FROM journey_calls GROUP BY rid HAVING count(*) >= 2),
     k AS (SELECT tpl FROM stations WHERE lat IS NOT NULL)
     SELECT uid, min(rid) AS trip_id, arg_min(origin, rid) AS origin, arg_min(destination, rid) AS destination FROM e JOIN outcomes USING (rid)
     WHERE origin IN (SELECT tpl FROM k) AND destination IN (SELECT tpl FROM k) GROUP BY uid"""),
    ("gtfs_expand_calls", lambda v: B.expand_calls(_stops(v), _known(v), "2024-01-01"), """
     SELECT rid AS trip_id, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS operating_date, tpl AS place, seq AS call_order
     FROM journey_calls, range(7) r(i) WHERE tpl IN (SELECT tpl FROM stations WHERE lat IS NOT NULL)"""),
    ("build_cancelled_journey", lambda v: B.cancelled_journeys(v.journey_calls.withColumn("is_cancelled", C("arr_delay_mins") > 20)), """
     SELECT rid, arg_min(tpl, seq) AS origin_tpl, arg_max(tpl, seq) AS destination_tpl, 0 AS reason_class FROM journey_calls
     GROUP BY rid HAVING bool_and(arr_delay_mins > 20)"""),
]
