"""The guided query over its three subjects, the full board, and state rules in full: (name, query over the views, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.functions import scalars as S
from punctuo.operators import explorer as E
from punctuo.operators import live as B
from punctuo.operators import states as T

C = F.col
SEEN, RUN = "2024-01-31 00:00:00", "2001-08-03 00:00:00"

#: Trains cancelled at a stop, as records of cancellations.
CANCELLED = """
SELECT c.rid, o.uid, c.tpl AS origin_crs, {WD:c.sched_dep} AS weekday, CAST(hour(c.sched_dep) AS INT) AS departure_hour, c.sched_dep AS recorded_at
FROM (SELECT rid, tpl, sched_dep, row_number() OVER (PARTITION BY rid ORDER BY seq) AS k FROM journey_calls WHERE is_cancelled) c JOIN outcomes o ON o.rid = c.rid WHERE k = 1"""


def _ask(v, **raw) -> DataFrame:
    q = E.ask(raw)
    rows = {"observations": lambda: v.observations, "predictions": lambda: v.outcomes, "cancellations": lambda: v.sql(CANCELLED)}[q.subject]()
    as_of = SEEN if q.subject == "observations" else RUN
    return E.listed(q, rows, v.services, as_of) if q.measure == "list" else E.answer(q, rows, v.services, as_of)


#: The live state of trains: one in three has no reading, one in four no live platform, one in nine is cancelled.
TRAINS = """
SELECT c.rid, c.tpl AS origin, j.destination_tpl AS destination, c.sched_dep AS departure, CASE WHEN CAST(c.rid AS BIGINT) % 3 > 0 THEN c.actual_dep END AS estimated,
  CASE WHEN CAST(c.rid AS BIGINT) % 3 > 0 THEN c.dep_delay_mins END AS reported, o.predicted_delay_mins AS predicted,
  CASE WHEN CAST(c.rid AS BIGINT) % 4 > 0 THEN 'L' || CAST(CAST(c.rid AS BIGINT) % 9 AS STRING) END AS live_platform, CAST(NULL AS STRING) AS planned_platform,
  CAST(c.rid AS BIGINT) % 9 = 0 AS is_cancelled, c.sched_dep AS estimated_at, c.sched_arr AS reported_at, CAST(NULL AS TIMESTAMP) AS platform_at, o.predicted_at AS cancelled_at
FROM journey_calls c JOIN journeys j ON j.rid = c.rid JOIN outcomes o ON o.rid = c.rid WHERE c.seq = 0"""
#: Stations of the board, of which every second train names the tiploc in small letters, and planned calls at some of them.
CODES = "SELECT 'P' || substr(tpl, 4) AS crs, lower(tpl) AS tiploc FROM stations"
PLANNED = """
SELECT 'P' || substr(tpl, 4) AS place, 'C' || lpad(CAST(CAST(rid AS BIGINT) % 997 AS STRING), 5, '0') AS uid, seq AS call_order,
  sched_dep + CAST(CAST(rid AS BIGINT) % 5 - 2 AS INT) * INTERVAL '1' MINUTE AS departure, CASE WHEN CAST(rid AS BIGINT) % 2 = 0 THEN CAST(seq + 1 AS STRING) END AS platform
FROM journey_calls WHERE seq < 2 AND tpl NOT IN ('T00001', 'T00002')"""
NAMES = "SELECT DISTINCT origin_crs AS code, 'Town ' || origin_crs AS name FROM outcomes WHERE origin_crs <> 'S3'"
BOARD = ["place", "rid", "delay_mins", "platform", "is_platform_planned", "is_cancelled", "secs_ago", "destination_name", "predicted"]


def _board(v) -> DataFrame:
    live = B.station_snapshot(v.sql(TRAINS), v.sql(CODES), "1998-08-02 12:00:00")
    found = B.station_board(v.sql(PLANNED), live, v.sql(NAMES))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return found.select(at("departure"), at("estimated"), *BOARD)


def _running(v) -> DataFrame:
    return v.journeys.select("rid", C("origin_delay_mins").alias("delay_mins"), (C("rid").cast("long") % 9 == 0).alias("is_cancelled"))


def _sources(v) -> DataFrame:
    names = v.nation.filter("n_nationkey < 6").select(F.concat(F.lit("R"), C("n_nationkey").cast("string")).alias("source"), (C("n_nationkey") != 2).alias("enabled"))
    seen = v.observations.filter("obs_id % 6 <> 4").select(F.concat(F.lit("R"), (C("obs_id") % 6).cast("string")).alias("source"), "recorded_at")
    return T.source_states(names, seen, "source", "recorded_at", "2024-01-30 23:59:00", 3600)


def _by_source(v) -> DataFrame:
    number = C("rid").cast("long")
    base = v.journey_calls.select("rid", number.alias("k"), "seq", "dep_delay_mins", "sched_dep", "tpl")
    feed = base.filter("seq < 3 and k % 3 = 0").select("rid", C("dep_delay_mins").alias("delay"), F.lit(None).cast("string").alias("platform"), C("sched_dep").alias("seen_at"))
    poll = base.filter("seq > 1").select("rid", (C("seq") + 100).alias("delay"), F.when(C("k") % 2 == 0, C("tpl")).alias("platform"), C("seq").alias("counter"))
    guess = base.filter("seq = 0").select("rid", F.lit(-1).alias("delay"), F.lit("none").alias("platform"))
    return T.by_source(feed, poll, guess, ["rid"], ["delay", "platform"])


def _features(v) -> DataFrame:
    """Named features as JSON and read again, among them one that is missing."""
    names = {"weekday": C("weekday"), "departure_hour": C("departure_hour"), "delay": C("delay_mins"), "half": C("delay_mins") / 2.0, "predicted": C("predicted_delay_mins")}
    text = F.to_json(F.struct(*[c.cast("double").alias(n) for n, c in names.items()]))
    return v.observations.select("obs_id", text.alias("j")).select(
        "obs_id", F.size(F.json_object_keys("j")).alias("n"), F.get_json_object("j", "$.half").cast("double").alias("half"), F.from_json("j", "predicted double")["predicted"].alias("predicted")
    )


def _labels(v) -> DataFrame:
    rows = v.outcomes
    return rows.select("rid", F.concat("origin_crs", F.lit(" → "), "destination_crs").alias("route"), S.confidence_label(C("prediction_confidence")).alias("trust"),
        S.weekday_name(F.weekday("scheduled_departure")).alias("weekday"), S.hour_label(F.hour("scheduled_departure")).alias("hour"))


def _training_rules(v) -> DataFrame:
    at = C("recorded_at")
    return v.observations.select("obs_id", S.minutes_until_training(C("departure_hour") * 3 % 24, F.hour(at)).alias("minutes"), S.wind_bin(C("delay_mins")).alias("level"))


_WINDOW = "recorded_at > TIMESTAMP '{}' - INTERVAL '{}' HOUR"
_OBS = f"FROM observations d LEFT JOIN services s ON s.uid = d.uid WHERE {_WINDOW.format(SEEN, 720)} AND delay_mins BETWEEN -120 AND 600"
_PRED = f"FROM outcomes p LEFT JOIN services s ON s.uid = p.uid WHERE finalised_at > TIMESTAMP '{RUN}' - INTERVAL '876000' HOUR AND final_delay_mins BETWEEN -120 AND 600"

LIST = [
    ("explore_routes_p90", lambda v: _ask(v, window="30d", group="route", measure="p90", weekdays="0,2,9,x,4", from_hour=-3, to_hour=17, limit=900), f"""
     SELECT origin_crs || ' → ' || coalesce(destination_crs, '?') AS label, CAST(quantile_cont(delay_mins, 0.9) AS DOUBLE) AS value, count(*) AS n {_OBS}
       AND weekday IN (0, 2, 4) AND departure_hour BETWEEN 0 AND 17 GROUP BY 1 ORDER BY n DESC, label LIMIT 500"""),
    ("explore_days_on_time", lambda v: _ask(v, window="30d", group="day", measure="on_time_pct", since="2024-01-05", until="2024-01-20", operator="R1", min_delay="-5"), f"""
     SELECT strftime(recorded_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London', '%Y-%m-%d') AS label, 100.0 * avg(CAST(delay_mins <= 0 AS INTEGER)) AS value, count(*) AS n {_OBS}
       AND CAST(recorded_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND toc = 'R1' AND delay_mins >= -5 GROUP BY 1"""),
    ("explore_list", lambda v: _ask(v, window="7d", limit=0, destination="zz", from_hour="20"), f"""
     SELECT d.uid, origin_crs AS origin, coalesce(toc, '—') AS operator, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][weekday + 1] AS weekday,
       lpad(CAST(departure_hour AS VARCHAR), 2, '0') || ':00' AS hour, delay_mins, strftime(recorded_at, '%Y-%m-%d %H:%M') AS recorded {_OBS.replace("720", "168")}
       AND departure_hour >= 20 ORDER BY recorded_at DESC, d.uid, origin_crs LIMIT 1"""),
    ("explore_predictions_by_operator", lambda v: _ask(v, subject="predictions", window="all", group="operator", measure="mae"), f"""
     SELECT coalesce(toc, 'Unknown') AS label, avg(abs(final_delay_mins - predicted_delay_mins)) AS value, count(*) AS n {_PRED} GROUP BY 1"""),
    ("explore_predictions_by_hour", lambda v: _ask(v, subject="predictions", window="all", group="hour", measure="avg_confidence", weekdays="5,6"), f"""
     SELECT lpad(CAST(hour(scheduled_departure) AS VARCHAR), 2, '0') || ':00' AS label, avg(prediction_confidence) AS value, count(*) AS n {_PRED}
       AND {{WD:scheduled_departure}} IN (5, 6) GROUP BY 1"""),
    ("explore_predictions_all", lambda v: _ask(v, subject="predictions", window="all", measure="p90", min_delay=9999), f"""
     SELECT 'All' AS label, CAST(count(*) AS DOUBLE) AS value, count(*) AS n {_PRED}"""),
    ("explore_cancellations_by_weekday", lambda v: _ask(v, subject="cancellations", window="all", group="weekday"), f"""
     SELECT ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][weekday + 1] AS label, CAST(count(*) AS DOUBLE) AS value, count(*) AS n FROM ({CANCELLED}) c GROUP BY 1"""),
    ("explore_cancellations_by_destination", lambda v: _ask(v, subject="cancellations", window="all", group="destination", measure="mae", from_hour=6, to_hour=30), f"""
     SELECT coalesce(destination_crs, '?') AS label, CAST(count(*) AS DOUBLE) AS value, count(*) AS n FROM ({CANCELLED}) c LEFT JOIN services s ON s.uid = c.uid
     WHERE departure_hour >= 6 GROUP BY 1"""),
    ("station_board", _board, f"""
     WITH t AS ({TRAINS}), c AS (SELECT crs, upper(tiploc) AS code FROM ({CODES}) q),
     l AS (SELECT crs AS place, t.*, coalesce(reported, predicted) AS best, greatest(0, date_diff('second', greatest(estimated_at, reported_at, cancelled_at), TIMESTAMP '1998-08-02 12:00:00')) AS ago
       FROM t JOIN c ON code = upper(origin)),
     p AS ({PLANNED}),
     m AS (SELECT p.place, uid, call_order, p.departure, arg_min(l, (l.departure, l.rid)) AS x FROM p JOIN l ON l.place = p.place
       AND abs(date_diff('second', l.departure, p.departure)) <= 120 GROUP BY ALL),
     n AS ({NAMES})
     SELECT strftime(p.departure, '%Y-%m-%d %H:%M') AS departure, strftime(x.estimated, '%Y-%m-%d %H:%M') AS estimated, p.place, coalesce(x.rid, p.uid) AS rid, x.best AS delay_mins,
       coalesce(x.live_platform, p.platform) AS platform, x.live_platform IS NULL AND p.platform IS NOT NULL AS is_platform_planned, x.is_cancelled AS is_cancelled, x.ago AS secs_ago,
       n.name AS destination_name, x.predicted AS predicted
     FROM p LEFT JOIN m ON m.place = p.place AND m.uid = p.uid AND m.call_order = p.call_order AND m.departure = p.departure LEFT JOIN n ON n.code = x.destination
     UNION ALL SELECT strftime(departure, '%Y-%m-%d %H:%M'), strftime(estimated, '%Y-%m-%d %H:%M'), place, rid, best, live_platform, FALSE, is_cancelled, ago, destination, predicted
     FROM l WHERE place NOT IN (SELECT place FROM p)"""),
    ("replay_sample", lambda v: B.replay_sample(v.outcomes, v.journeys, v.sql("SELECT DISTINCT origin_crs AS tpl, 'Z' || substr(origin_crs, 2) AS code FROM outcomes WHERE origin_crs <> 'S2'"), "1996-01-01", "1996-12-31", 50), """
     WITH r AS (SELECT o.rid, coalesce(toc, '—') AS toc, origin_tpl, destination_tpl, o.scheduled_departure, predicted_delay_mins, final_delay_mins,
       row_number() OVER (ORDER BY o.scheduled_departure, o.rid) - 1 AS k, count(*) OVER () AS n FROM outcomes o JOIN journeys j USING (rid)
       WHERE CAST(o.scheduled_departure AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND final_delay_mins IS NOT NULL)
     SELECT i AS place, rid, toc, CASE WHEN origin_tpl = 'S2' THEN 'S2' ELSE 'Z' || origin_tpl[2:] END AS origin, CASE WHEN destination_tpl = 'S2' THEN 'S2' ELSE 'Z' || destination_tpl[2:] END AS destination,
       scheduled_departure, predicted_delay_mins, final_delay_mins FROM range(50) x(i) JOIN r ON k = (i * n) // 50 WHERE n > 50
     UNION ALL SELECT k, rid, toc, CASE WHEN origin_tpl = 'S2' THEN 'S2' ELSE 'Z' || origin_tpl[2:] END, CASE WHEN destination_tpl = 'S2' THEN 'S2' ELSE 'Z' || destination_tpl[2:] END,
       scheduled_departure, predicted_delay_mins, final_delay_mins FROM r WHERE n <= 50"""),
    ("source_priority_of_three", _by_source, """
     WITH b AS (SELECT rid, CAST(rid AS BIGINT) AS k, seq, dep_delay_mins, epoch_ms(sched_dep) AS ms, tpl FROM journey_calls),
     u AS (SELECT rid, dep_delay_mins AS delay, NULL AS platform, ms AS version FROM b WHERE seq < 3 AND k % 3 = 0
       UNION ALL SELECT rid, seq + 100, CASE WHEN k % 2 = 0 THEN tpl END, seq FROM b WHERE seq > 1 UNION ALL SELECT rid, -1, 'none', 0 FROM b WHERE seq = 0)
     SELECT rid, arg_max(delay, (version, delay)) FILTER (delay IS NOT NULL) AS delay, arg_max(platform, (version, platform)) FILTER (platform IS NOT NULL) AS platform FROM u GROUP BY rid"""),
    ("merge_calls_sticky", lambda v: T.merged_calls(v.journey_calls.withColumn("place", C("seq") % 3), ["rid", "place"], ["dep_delay_mins", "tpl"], "seq", "is_cancelled"), """
     SELECT rid, seq % 3 AS place, arg_max(dep_delay_mins, seq) FILTER (dep_delay_mins IS NOT NULL) AS dep_delay_mins, arg_max(tpl, seq) AS tpl, bool_or(is_cancelled) AS is_cancelled
     FROM journey_calls GROUP BY 1, 2"""),
    ("network_now", lambda v: T.network_now(_running(v), v.journey_calls, "1996-06-01 09:15:00"), """
     WITH e AS (SELECT rid, arg_min(coalesce(actual_dep, sched_dep), seq) AS f, arg_max(coalesce(actual_arr, sched_arr), seq) AS l FROM journey_calls GROUP BY rid),
     t AS (SELECT rid, coalesce(origin_delay_mins, 0) AS d, CAST(rid AS BIGINT) % 9 = 0 AS x FROM journeys JOIN e USING (rid) WHERE f <= TIMESTAMP '1996-06-01 09:15:00' AND l >= TIMESTAMP '1996-06-01 09:15:00')
     SELECT 'tracked' AS kind, NULL AS rid, count(*) AS value FROM t UNION ALL SELECT 'cancelled', NULL, count(*) FROM t WHERE x
     UNION ALL SELECT 'late', NULL, count(*) FROM t WHERE NOT x AND d > 0 UNION ALL SELECT 'on_time', NULL, count(*) FROM t WHERE NOT x AND d <= 0
     UNION ALL SELECT * FROM (SELECT 'worst', rid, CAST(d AS BIGINT) FROM t WHERE NOT x AND d > 0 ORDER BY d DESC, rid LIMIT 5) q"""),
    ("mean_recent_of_other_trains", lambda v: T.recent_mean_of_other_trains(v.observations, ["origin_crs"], "uid", F.lit("2024-01-30 12:00:00").cast("timestamp"), 600, 3), """
     WITH r AS (SELECT * FROM observations WHERE recorded_at BETWEEN TIMESTAMP '2024-01-30 02:00:00' AND TIMESTAMP '2024-01-30 12:00:00')
     SELECT a.obs_id, CASE WHEN count(b.obs_id) >= 3 THEN avg(b.delay_mins) ELSE 0 END AS mean_others FROM r a LEFT JOIN r b ON b.origin_crs = a.origin_crs AND b.uid <> a.uid GROUP BY a.obs_id"""),
    ("tracking_board_running", lambda v: T.next_departures(v.outcomes.withColumn("is_cancelled", C("rid").cast("long") % 4 == 0), "1996-06-01 09:00:00"), """
     SELECT rid, scheduled_departure, predicted_delay_mins FROM outcomes WHERE scheduled_departure >= TIMESTAMP '1996-06-01 08:55:00' AND predicted_delay_mins IS NOT NULL
       AND CAST(rid AS BIGINT) % 4 <> 0 ORDER BY scheduled_departure, rid LIMIT 24"""),
    ("source_states", _sources, """
     WITH s AS (SELECT 'R' || n_nationkey AS source, n_nationkey AS k FROM nation WHERE n_nationkey < 6),
     a AS (SELECT 'R' || (obs_id % 6) AS source, date_diff('second', max(recorded_at), TIMESTAMP '2024-01-30 23:59:00') AS lag FROM observations WHERE obs_id % 6 <> 4 GROUP BY 1),
     x AS (SELECT source, CASE WHEN k = 2 THEN 'disabled' WHEN lag IS NULL THEN 'starting' WHEN lag > 3600 THEN 'stale' ELSE 'fresh' END AS state, lag FROM s LEFT JOIN a USING (source))
     SELECT source, state, CASE WHEN state IN ('fresh', 'stale') THEN lag END AS lag_s FROM x"""),
    ("features_json_named", _features, """
     SELECT obs_id, CASE WHEN predicted_delay_mins IS NULL THEN 4 ELSE 5 END AS n, delay_mins / 2.0 AS half, CAST(predicted_delay_mins AS DOUBLE) AS predicted FROM observations"""),
    ("route_and_trust_labels", _labels, """
     SELECT rid, origin_crs || ' → ' || destination_crs AS route, CASE WHEN prediction_confidence >= 0.66 THEN 'High' WHEN prediction_confidence >= 0.33 THEN 'Medium'
       WHEN prediction_confidence IS NOT NULL THEN 'Low' END AS trust, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][{WD:scheduled_departure} + 1] AS weekday,
       lpad(CAST(hour(scheduled_departure) AS VARCHAR), 2, '0') || ':00' AS hour FROM outcomes"""),
    ("training_rules", _training_rules, """
     SELECT obs_id, CAST(greatest(-360, least(360, CASE WHEN g < -720 THEN g + 1440 ELSE g END)) AS INTEGER) AS minutes,
       CASE WHEN delay_mins <= 20 THEN 0 WHEN delay_mins <= 35 THEN 1 WHEN delay_mins <= 50 THEN 2 ELSE 3 END AS level
     FROM (SELECT obs_id, delay_mins, (departure_hour * 3 % 24 - hour(recorded_at)) * 60 AS g FROM observations) x"""),
]
