"""Report queries: (name, query over the views, DuckDB SQL over the same views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuo.operators import reports as R

AS_OF, FAR = "2024-01-31 00:00:00", "2001-08-03 00:00:00"
_W = "recorded_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '{h}' HOUR AND delay_mins BETWEEN -120 AND 600"
W168, W720 = _W.format(h=168), _W.format(h=720)
SANE = "delay_mins BETWEEN -120 AND 600"
FINAL = "final_delay_mins IS NOT NULL AND final_delay_mins BETWEEN -120 AND 600"
BEST = "coalesce(arrival_delay_mins, origin_delay_mins)"


def pct(cond: str, value: str) -> str:
    return f"100.0 * avg(CASE WHEN {cond} THEN 1e0 WHEN {value} IS NOT NULL THEN 0e0 END)"


OBSERVED = f"""{pct("delay_mins <= 0", "delay_mins")} AS on_time_pct, avg(delay_mins) AS mean_delay,
  avg(abs(delay_mins - predicted_delay_mins)) AS mae, count(*) AS n"""
JOURNEYED = f"""{pct(BEST + " <= 5", BEST)} AS on_time_pct, avg({BEST}) AS mean_delay, avg(abs(f - p)) AS mae, count(*) AS n"""
JP = """(SELECT j.*, o.predicted_delay_mins AS p, o.final_delay_mins AS f FROM journeys j LEFT JOIN outcomes o USING (rid))"""
ACCURACY = """avg(abs(final_delay_mins - predicted_delay_mins)) AS mae, avg(predicted_delay_mins) AS mean_predicted,
  avg(final_delay_mins) AS mean_actual, count(*) AS n"""
EXPLORED = f"""count(*) AS n, avg(delay_mins) AS mean_delay, {pct("delay_mins <= 0", "delay_mins")} AS on_time_pct,
  quantile_cont(delay_mins, 0.5) AS p50, quantile_cont(delay_mins, 0.9) AS p90,
  avg(abs(delay_mins - predicted_delay_mins)) AS mae"""
BANDS = """CASE WHEN {0} <= 0 THEN 0 WHEN {0} <= 5 THEN 1 WHEN {0} <= 15 THEN 6 WHEN {0} <= 30 THEN 16
  WHEN {0} <= 60 THEN 31 ELSE 61 END AS band"""
YEAR = 24 * 365
IN_YEAR = "{0} > TIMESTAMP '2001-08-03 00:00:00' - INTERVAL '8760' HOUR"
FINALW = FINAL + " AND " + IN_YEAR.format("finalised_at")
OPERATED = IN_YEAR.format("finalised_at") + f" AND {BEST} BETWEEN -120 AND 600"
SINCE = "recorded_at >= TIMESTAMP '2024-01-10 00:00:00' AND " + SANE
LONDON = "CAST(({0} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS DATE)"

LIST = [
    ("headline_metrics", lambda v: R.headline_metrics(v.observations, AS_OF, 168), f"SELECT {OBSERVED} FROM observations WHERE {W168}"),
    ("window_and_sanity", lambda v: R.recent(v.observations, AS_OF, 168).select("obs_id", "delay_mins"),
     f"SELECT obs_id, delay_mins FROM observations WHERE {W168}"),
    ("daily_series", lambda v: R.daily_series(v.observations, AS_OF, 720),
     f"SELECT {LONDON.format('recorded_at')} AS day, {OBSERVED} FROM observations WHERE {W720} GROUP BY 1"),
    ("trend_delta", lambda v: R.trend_delta(R.daily_series(v.observations, AS_OF, 720), "mean_delay"),
     f"""WITH s AS (SELECT CAST(recorded_at AS DATE) AS day, avg(delay_mins) AS m FROM observations WHERE {W720} GROUP BY 1)
     SELECT CASE WHEN count(*) >= 2 THEN max_by(m, day) - min_by(m, day) END AS delta FROM s"""),
    ("journey_metrics", lambda v: R.journey_metrics(v.journeys, FAR, 24 * 365), f"""
     SELECT {pct("arrival_delay_mins <= 5", "arrival_delay_mins")} AS on_time_pct, avg(arrival_delay_mins) AS mean_delay,
       100.0 * avg(CASE WHEN recovered_mins >= 2 THEN 1e0 ELSE 0e0 END) AS recovered_pct,
       avg(CASE WHEN recovered_mins > 0 THEN recovered_mins END) AS mean_recovered, count(*) AS n
     FROM journeys WHERE finalised_at > TIMESTAMP '2001-08-03 00:00:00' - INTERVAL '8760' HOUR
       AND arrival_delay_mins BETWEEN -120 AND 600"""),
    ("coverage_counts", lambda v: R.coverage_counts(observations=v.observations, journeys=v.journeys, outcomes=v.outcomes),
     """SELECT (SELECT count(*) FROM observations) AS observations, (SELECT count(*) FROM journeys) AS journeys,
       (SELECT count(*) FROM outcomes) AS outcomes"""),
    ("operator_league", lambda v: R.operator_league(v.journeys, v.operators, v.outcomes, FAR, YEAR, 20, 10), f"""
     SELECT toc, coalesce(name, toc) AS name, coalesce(brand_color, '#9aa7b4') AS brand_color, on_time_pct, mean_delay, mae, n
     FROM (SELECT toc, {JOURNEYED} FROM {JP} WHERE {OPERATED} AND toc <> '' GROUP BY toc HAVING count(*) >= 20) a
     LEFT JOIN operators USING (toc) ORDER BY on_time_pct DESC NULLS LAST, toc LIMIT 10"""),
    ("operator_detail", lambda v: R.operator_detail(v.journeys, v.outcomes, "R2", FAR, YEAR), f"SELECT {JOURNEYED} FROM {JP} WHERE {OPERATED} AND toc = 'R2'"),
    ("operator_daily_series", lambda v: R.operator_daily_series(v.journeys, "R2", FAR, YEAR), f"""
     SELECT {LONDON.format('finalised_at')} AS day, {pct(BEST + " <= 5", BEST)} AS on_time_pct, avg({BEST}) AS mean_delay,
       count(*) AS n FROM journeys WHERE {OPERATED} AND toc = 'R2' GROUP BY 1"""),
    ("operator_delay_distribution", lambda v: R.operator_delay_distribution(v.journeys, "R2", FAR, YEAR),
     f"SELECT {BANDS.format(BEST)}, count(*) AS n FROM journeys WHERE {OPERATED} AND toc = 'R2' GROUP BY 1"),
    ("operator_routes", lambda v: R.operator_routes(v.journeys, "R2", FAR, YEAR, 20), f"""
     SELECT origin_tpl, destination_tpl, {pct(BEST + " <= 5", BEST)} AS on_time_pct, avg({BEST}) AS mean_delay, count(*) AS n
     FROM journeys WHERE {OPERATED} AND toc = 'R2' GROUP BY 1, 2 ORDER BY mean_delay DESC NULLS LAST, 1, 2 LIMIT 20"""),
    ("operator_highlights", lambda v: R.operator_highlights(v.journeys, v.operators, FAR, YEAR), f"""
     SELECT toc, coalesce(name, toc) AS name, on_time_pct, n FROM (SELECT toc,
       100.0 * avg(CASE WHEN {BEST} <= 5 THEN 1e0 ELSE 0e0 END) AS on_time_pct, count(*) AS n FROM journeys
       WHERE {IN_YEAR.format("scheduled_departure")} AND toc <> '' GROUP BY toc HAVING count(*) >= 20) a
     LEFT JOIN operators USING (toc) ORDER BY on_time_pct DESC, toc LIMIT 6"""),
    ("calibration_curve", lambda v: R.calibration_curve(v.outcomes, FAR, YEAR), f"""
     SELECT {BANDS.format("predicted_delay_mins")}, avg(predicted_delay_mins) AS mean_predicted,
       avg(final_delay_mins) AS mean_actual, count(*) AS n FROM outcomes WHERE {FINALW} GROUP BY 1"""),
    ("confidence_error", lambda v: R.confidence_error(v.outcomes, FAR, YEAR), f"""
     SELECT CAST(least(floor(prediction_confidence * 5), 4) AS INTEGER) AS band,
       avg(abs(final_delay_mins - predicted_delay_mins)) AS mae, count(*) AS n
     FROM outcomes WHERE {FINALW} AND prediction_confidence IS NOT NULL GROUP BY 1"""),
    ("error_distribution", lambda v: R.error_distribution(v.outcomes, FAR, YEAR), f"""
     SELECT CASE WHEN e < -15 THEN -999 WHEN e < -5 THEN -15 WHEN e < -2 THEN -5 WHEN e < 2 THEN -2 WHEN e < 5 THEN 2
       WHEN e < 15 THEN 5 ELSE 15 END AS band, count(*) AS n
     FROM (SELECT final_delay_mins - predicted_delay_mins AS e FROM outcomes WHERE {FINALW}) x GROUP BY 1"""),
    ("accuracy_over_time", lambda v: R.accuracy_over_time(v.outcomes, FAR, YEAR),
     f"SELECT {LONDON.format('finalised_at')} AS day, {ACCURACY} FROM outcomes WHERE {FINALW} GROUP BY 1"),
    ("accuracy_summary", lambda v: R.accuracy_summary(v.outcomes, FAR, YEAR), f"""
     SELECT {ACCURACY}, count(*) FILTER (abs(final_delay_mins - predicted_delay_mins) <= 5) AS within_5,
       avg(final_delay_mins - predicted_delay_mins) AS bias FROM outcomes WHERE {FINALW}"""),
    ("leadtime_accuracy", lambda v: R.leadtime_accuracy(v.snapshots, v.outcomes, FAR, YEAR), f"""
     SELECT CASE WHEN m < 15 THEN 0 WHEN m < 30 THEN 15 WHEN m < 60 THEN 30 WHEN m < 120 THEN 60 ELSE 120 END AS band,
       avg(abs(final_delay_mins - p)) AS mae, count(*) AS n
     FROM (SELECT date_diff('second', snapshotted_at, scheduled_departure) / 60 AS m, s.predicted_delay_mins AS p,
       final_delay_mins FROM snapshots s JOIN outcomes USING (rid) WHERE {FINAL} AND {IN_YEAR.format('snapshotted_at')}) x GROUP BY 1"""),
    ("busiest_origins", lambda v: R.busiest_origins(v.observations, AS_OF, 720, 3), f"""
     SELECT origin_crs, count(*) AS n, {pct("delay_mins <= 0", "delay_mins")} AS on_time_pct, avg(delay_mins) AS mean_delay
     FROM observations WHERE {W720} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3"""),
    ("station_summary", lambda v: R.station_summary(v.observations, AS_OF, 720, "click"),
     f"SELECT {OBSERVED}, stddev_samp(delay_mins) AS std FROM observations WHERE {W720} AND origin_crs = 'click'"),
    ("station_heatmap", lambda v: R.station_heatmap(v.observations, AS_OF, 720, "click"), f"""
     SELECT weekday, departure_hour, avg(delay_mins) AS mean_delay, count(*) AS n FROM observations
     WHERE {W720} AND origin_crs = 'click' GROUP BY 1, 2"""),
    ("station_busiest_services", lambda v: R.station_busiest_services(v.observations, v.services, AS_OF, 720, "click", 8), f"""
     SELECT uid, destination_crs, toc, n, mean_delay, std, on_time_pct,
       CASE WHEN std < 3 THEN 'steady' WHEN std < 8 THEN 'variable' ELSE 'erratic' END AS reliability
     FROM (SELECT uid, count(*) AS n, avg(delay_mins) AS mean_delay, stddev_samp(delay_mins) AS std,
       {pct("delay_mins <= 0", "delay_mins")} AS on_time_pct FROM observations
       WHERE {W720} AND origin_crs = 'click' GROUP BY 1) a LEFT JOIN services USING (uid) ORDER BY n DESC, uid LIMIT 8"""),
    ("report_summary", lambda v: R.report_summary(v.observations, "2024-01-10 00:00:00"), f"""
     SELECT count(*) AS n, count(DISTINCT uid || '|' || origin_crs) AS services, avg(delay_mins) AS mean_delay,
       avg(predicted_delay_mins) AS mean_predicted, avg(abs(delay_mins - predicted_delay_mins)) AS mae,
       100.0 * avg(CASE WHEN predicted_delay_mins IS NOT NULL THEN 1e0 ELSE 0e0 END) AS coverage_pct,
       {pct("delay_mins <= 0", "delay_mins")} AS on_time_pct,
       {pct("abs(delay_mins - predicted_delay_mins) <= 5", "predicted_delay_mins")} AS within_5_pct,
       {pct("abs(delay_mins - predicted_delay_mins) <= 10", "predicted_delay_mins")} AS within_10_pct
     FROM observations WHERE {SINCE}"""),
    ("report_daily", lambda v: R.report_daily(v.observations, "2024-01-10 00:00:00"),
     f"SELECT CAST(recorded_at AS DATE) AS day, {OBSERVED} FROM observations WHERE {SINCE} GROUP BY 1"),
    ("report_hourly", lambda v: R.report_hourly(v.observations, "2024-01-10 00:00:00"),
     f"SELECT departure_hour, count(*) AS n, avg(delay_mins) AS mean_delay FROM observations WHERE {SINCE} GROUP BY 1"),
    ("report_services", lambda v: R.report_services(v.observations, "2024-01-10 00:00:00"), f"""
     SELECT uid, weekday, origin_crs, departure_hour, count(*) AS n, avg(delay_mins) AS mean_delay,
       100.0 * avg(CASE WHEN predicted_delay_mins IS NOT NULL THEN 1e0 ELSE 0e0 END) AS coverage_pct
     FROM observations WHERE {SINCE} GROUP BY 1, 2, 3, 4 ORDER BY n DESC, 1, 2, 3, 4 LIMIT 100"""),
    ("showcase_kpis", lambda v: R.showcase_kpis(v.observations, AS_OF, 720), f"""
     SELECT count(*) AS n, count(DISTINCT uid) AS services, {pct("delay_mins <= 5", "delay_mins")} AS on_time_pct,
       avg(abs(delay_mins - predicted_delay_mins)) AS mae,
       {pct("abs(delay_mins - predicted_delay_mins) <= 5", "predicted_delay_mins")} AS within_5_pct
     FROM observations WHERE {W720}"""),
    ("map_day_operators", lambda v: R.map_day_operators(v.journeys), f"""
     SELECT toc, CAST(round({pct(BEST + " <= 5", BEST)}) AS INTEGER) AS on_time_pct, count(*) AS n FROM journeys
     WHERE toc IS NOT NULL GROUP BY toc HAVING count(*) >= 25 ORDER BY n DESC, toc LIMIT 14"""),
    ("map_day_hourly", lambda v: R.map_day_hourly(v.journeys), f"""
     SELECT CAST(hour(scheduled_departure) AS INTEGER) AS hour, {pct(BEST + " > 5", BEST)} AS late_pct, count(*) AS n
     FROM journeys WHERE {BEST} IS NOT NULL GROUP BY 1"""),
    ("map_day_about", lambda v: R.map_day_about(v.journeys, v.journey_calls, v.outcomes), f"""
     SELECT * FROM (SELECT count(*) AS journeys, CAST(round({pct(BEST + " <= 5", BEST)}) AS INTEGER) AS on_time_pct,
       count(DISTINCT toc) AS operators FROM journeys) a,
     (SELECT count(*) AS predictions, round(avg(abs(final_delay_mins - predicted_delay_mins)), 1) AS mae,
       CAST(round(100.0 * avg(CASE WHEN abs(final_delay_mins - predicted_delay_mins) <= 5 THEN 1e0 ELSE 0e0 END)) AS INTEGER)
       AS within_5_pct FROM outcomes WHERE {FINAL}) b, (SELECT count(*) AS calls FROM journey_calls) c"""),
    ("recent_counts", lambda v: R.recent_counts(v.journeys, v.timetable_calls, "1998-05-05 12:00:00", 48), """
     SELECT (SELECT count(*) FROM journeys WHERE finalised_at > TIMESTAMP '1998-05-05 12:00:00' - INTERVAL '48' HOUR)
       AS journeys, (SELECT count(*) FROM timetable_calls WHERE operating_date = DATE '1998-05-05') AS timetable"""),
    ("data_by_day", lambda v: R.data_by_day(v.observations),
     "SELECT CAST(recorded_at AS DATE) AS day, count(*) AS n, avg(delay_mins) AS mean_delay FROM observations GROUP BY 1"),
    ("reason_accuracy", lambda v: R.reason_accuracy(v.outcomes, v.outcomes.select("rid", (F.col("rid").cast("long") % 200).cast("int").alias("code"))), f"""
     WITH x AS (SELECT abs(final_delay_mins - predicted_delay_mins) <= 5 AS hit,
       CASE WHEN CAST(rid AS BIGINT) % 200 IN (163, 166, 168, 148, 171) THEN 'structural'
         WHEN CAST(rid AS BIGINT) % 200 IN (100, 131, 134, 180, 185, 139) THEN 'exogenous' END AS cls FROM outcomes WHERE {FINAL})
     SELECT CASE WHEN hit AND cls IS NULL THEN 'clean' WHEN hit AND cls = 'structural' THEN 'earned' WHEN hit THEN 'coincidental'
       WHEN cls IS NULL THEN 'unexplained' WHEN cls = 'exogenous' THEN 'explained_miss' ELSE 'model_error' END AS verdict,
       count(*) AS n FROM x GROUP BY 1"""),
    ("recent_predictions", lambda v: R.recent_predictions(v.outcomes, 50), """
     SELECT rid, uid, origin_crs, predicted_delay_mins, final_delay_mins FROM outcomes
     ORDER BY predicted_at DESC, rid LIMIT 50"""),
    ("recent_settled", lambda v: R.recent_settled(v.outcomes, v.services, v.operators, 50), """
     SELECT rid, uid, toc, coalesce(name, toc) AS operator, predicted_delay_mins, final_delay_mins
     FROM (SELECT * FROM outcomes WHERE final_delay_mins IS NOT NULL ORDER BY finalised_at DESC, rid LIMIT 50) a
     LEFT JOIN services USING (uid) LEFT JOIN operators USING (toc)"""),
    ("replay_candidates", lambda v: R.replay_candidates(v.outcomes, 80), """
     SELECT rid, origin_crs, destination_crs, predicted_delay_mins, final_delay_mins FROM outcomes
     WHERE final_delay_mins BETWEEN -120 AND 600 AND predicted_delay_mins <> 0 ORDER BY scheduled_departure DESC, rid LIMIT 80"""),
    ("explore_grouped", lambda v: R.explore(v.observations, v.services, "operator", AS_OF, 720), f"""
     SELECT coalesce(toc, '?') AS label, {EXPLORED} FROM observations LEFT JOIN services USING (uid) WHERE {W720} GROUP BY 1"""),
    ("explore_filters", lambda v: R.explore(v.observations, v.services, "hour", AS_OF, 720, (6, 99), (0, 1, 9), "R1", 0), f"""
     SELECT lpad(CAST(departure_hour AS VARCHAR), 2, '0') || ':00' AS label, {EXPLORED}
     FROM observations JOIN services USING (uid)
     WHERE {W720} AND departure_hour BETWEEN 6 AND 23 AND weekday IN (0, 1) AND toc = 'R1' AND delay_mins >= 0 GROUP BY 1"""),
    ("explore_global", lambda v: R.explore(v.observations, v.services, "none", "1990-01-01 00:00:00", 24, min_delay=601),
     f"SELECT 'all' AS label, {EXPLORED} FROM observations WHERE delay_mins > 600 AND delay_mins < 0"),
    ("explore_all", lambda v: R.explore(v.observations, v.services, "none", AS_OF, 720), f"""
     SELECT 'all' AS label, {EXPLORED} FROM observations WHERE {W720}"""),
    ("observation_list", lambda v: R.observation_list(v.observations, v.services, 100), """
     SELECT obs_id, uid, toc, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][weekday + 1] AS day,
       lpad(CAST(departure_hour AS VARCHAR), 2, '0') || ':00' AS hour, strftime(recorded_at, '%Y-%m-%d %H:%M') AS recorded,
       delay_mins FROM (SELECT * FROM observations ORDER BY recorded_at DESC, obs_id LIMIT 100) a LEFT JOIN services USING (uid)"""),
    ("stride_sample", lambda v: R.stride_sample(R.recent_predictions(v.outcomes, 100), ["rid"], 7).select("rid"), """
     WITH x AS (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS r FROM (SELECT rid FROM outcomes
       ORDER BY predicted_at DESC, rid LIMIT 100) a)
     SELECT rid FROM x WHERE r IN (SELECT CAST(floor(i * 100 / 7) AS BIGINT) FROM range(7) t(i))"""),
    ("list_operators", lambda v: v.operators.orderBy("toc"), "SELECT * FROM operators ORDER BY toc"),
]
