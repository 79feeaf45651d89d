"""Reference joins, range joins and baselines: (name, query over the views, DuckDB SQL over the same views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctuo.operators import boards as B

PATTERN = ["uid", "weekday", "origin_crs"]

LIST = [
    ("join_services_left", lambda v: v.observations.join(v.services, "uid", "left").select("obs_id", "uid", "toc", "destination_crs"), """
     SELECT obs_id, o.uid, toc, destination_crs FROM observations o LEFT JOIN services s ON s.uid = o.uid"""),
    ("join_outcome_operator", lambda v: B.with_operator(v.outcomes.join(v.services.select("uid", "toc"), "uid", "left"), v.operators)
        .select("rid", "toc", "operator_name"), """
     SELECT rid, s.toc, p.name AS operator_name FROM outcomes o LEFT JOIN services s ON s.uid = o.uid
       LEFT JOIN operators p ON p.toc = s.toc"""),
    ("join_journey_prediction", lambda v: B.with_operator(v.journeys, v.operators)
        .join(v.outcomes.select("rid", "predicted_delay_mins", "final_delay_mins"), "rid", "left")
        .select("rid", "toc", "operator_name", "arrival_delay_mins", "predicted_delay_mins", "final_delay_mins"), """
     SELECT j.rid, j.toc, p.name AS operator_name, arrival_delay_mins, predicted_delay_mins, final_delay_mins
     FROM journeys j LEFT JOIN operators p ON p.toc = j.toc LEFT JOIN outcomes o ON o.rid = j.rid"""),
    ("code_or_name_fallback", lambda v: B.with_operator(v.journeys.select("rid", "toc"), v.operators)
        .select("rid", F.coalesce("operator_name", "toc").alias("operator")), """
     SELECT rid, coalesce(p.name, j.toc) AS operator FROM journeys j LEFT JOIN operators p ON p.toc = j.toc"""),
    ("busiest_day_pool", lambda v: B.busiest_day(v.observations).select("obs_id", "day"), """
     SELECT obs_id, CAST(recorded_at AS DATE) AS day FROM observations WHERE CAST(recorded_at AS DATE) = (
       SELECT CAST(recorded_at AS DATE) AS d FROM observations GROUP BY d ORDER BY count(*) DESC, d LIMIT 1)"""),
    ("trimmed_mean_baseline", lambda v: B.trimmed_baseline(v.observations, PATTERN), """
     WITH r AS (SELECT uid, weekday, origin_crs, delay_mins,
       row_number() OVER (PARTITION BY uid, weekday, origin_crs ORDER BY delay_mins, obs_id) AS pos,
       count(*) OVER (PARTITION BY uid, weekday, origin_crs) AS n FROM observations),
     t AS (SELECT *, greatest(1, n // 10) AS k FROM r)
     SELECT uid, weekday, origin_crs, n, avg(delay_mins) AS mean_delay FROM t
     WHERE n <= 2 * k OR pos BETWEEN k + 1 AND n - k GROUP BY 1, 2, 3, 4"""),
    ("consecutive_stop_pairs", lambda v: B.stop_pairs(v.journey_calls, v.stations), """
     WITH p AS (SELECT rid, seq, tpl AS from_tpl, lead(tpl) OVER w AS to_tpl, lead(seq) OVER w AS to_seq
       FROM journey_calls JOIN stations USING (tpl) WHERE lat IS NOT NULL AND lon IS NOT NULL
       WINDOW w AS (PARTITION BY rid ORDER BY seq))
     SELECT * FROM p WHERE to_tpl IS NOT NULL"""),
    ("asof_preceding_serving", lambda v: B.preceding_serving(v.outcomes), """
     SELECT a.rid, max_by(b.rid, (b.scheduled_departure, b.rid)) AS preceding_rid,
       max_by(b.final_delay_mins, (b.scheduled_departure, b.rid)) AS preceding_delay
     FROM outcomes a JOIN outcomes b ON b.origin_crs = a.origin_crs AND b.final_delay_mins > 5
       AND b.scheduled_departure >= a.scheduled_departure - INTERVAL '20' MINUTE
       AND b.scheduled_departure <= a.scheduled_departure - INTERVAL '1' MINUTE GROUP BY a.rid"""),
    ("location_cascade", lambda v: B.location_cascade(v.journey_calls), """
     SELECT a.rid AS source_rid, a.seq AS source_seq, b.rid, b.seq, a.arr_delay_mins AS delay_mins
     FROM journey_calls a JOIN journey_calls b ON a.tpl = b.tpl AND a.rid <> b.rid AND a.arr_delay_mins > 5
       AND b.sched_arr BETWEEN a.sched_arr - INTERVAL '20' MINUTE AND a.sched_arr + INTERVAL '20' MINUTE"""),
    ("evaluate_model", lambda v: B.evaluate(v.outcomes, F.col("predicted_delay_mins"), F.col("final_delay_mins")), """
     SELECT count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias,
       avg(CAST(abs(e) <= 2 AS DOUBLE)) AS within_2, avg(CAST(abs(e) <= 5 AS DOUBLE)) AS within_5,
       avg(CAST(abs(e) <= 10 AS DOUBLE)) AS within_10
     FROM (SELECT CAST(final_delay_mins - predicted_delay_mins AS DOUBLE) AS e FROM outcomes) x WHERE e IS NOT NULL"""),
]
