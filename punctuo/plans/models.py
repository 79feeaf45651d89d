"""Features, encodings, models and scores: (name, query over the views, DuckDB SQL over the same views or None).

Training has no SQL; those queries give measures, importances and scores.  Patterns leave out the hour, as the given table
has too few rows an hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.operators import boards as B
from punctuo.operators import links as L
from punctuo.operators import models as M
from punctuo.operators import states as T
from punctuo.sources.shared import cut

C = F.col
KEY = ["uid", "weekday", "origin_crs"]
_PLAIN = (
    "month", "is_peak", "rolling_mean_7d", "rolling_std_7d", "rolling_ontime_7d", "sample_count_log", "rolling_mean_14d", "rolling_std_14d",
    "current_delay_mins", "preceding_delay_mins", "wind_mph", "volatility_score", "mins_until_departure", "station_congestion_30m",
    "operator_cascade_delay", "predecessor_train_delay", "final_delay_mins", "is_journey_final",
)


def _engineered(v) -> DataFrame:
    return M.engineered(v.observations, v.weather_hourly, KEY)


def _encoded(v, keep: bool = False) -> DataFrame:
    """All rows with their part and the encodings of the fit dates; with ``keep`` read back from the shared folder, as several
    steps start from them."""
    rows = M.split_dates(_engineered(v))
    rows = cut(rows, "features") if keep else rows
    return M.apply_encodings(rows, M.fit_encodings(rows.filter("part = 'fit'")))


def _rows(spark, facts: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame([(k, n, float(x)) for k, n, x in facts], "kind string, name string, value double")


def _measures(table: DataFrame, kind: str) -> DataFrame:
    names = table.columns
    return table.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("name"), C(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")


def _trained(v, names, label: str):
    rows = cut(_encoded(v, keep=True), "encoded")
    if label == "final_delay_mins":
        rows = rows.filter("not is_journey_final")
    fit, held, test = (rows.filter(C("part") == p) for p in ("fit", "validation", "test"))
    return M.train(M.tiered(fit, label) if label == "final_delay_mins" else fit.withColumn("weight", F.lit(1.0)), held, names, label), fit.unionByName(held), test


def _day_ahead(v) -> DataFrame:
    model, before, test = _trained(v, M.DAY_AHEAD, "delay_mins")
    scored = model.transform(M.vectors(test))
    base = B.with_baseline(test, before, KEY)
    parts = [_measures(M.measured(scored, "prediction", "delay_mins"), "model"), _measures(M.measured(base, "baseline", "delay_mins"), "trimmed mean")]
    parts.append(_rows(v.spark, [("importance", n, x) for _, n, x in M.importances(model, M.DAY_AHEAD)]))
    return reduce(DataFrame.unionByName, parts)


def _later(v) -> DataFrame:
    """Predictions of the later dates from the earlier ones; an hour that a pattern never had takes the mean of all."""
    early = C("recorded_at") < F.lit("2024-01-25").cast("timestamp")
    return B.with_baseline(v.observations.filter(~early), v.observations.filter(early), M.PATTERN).select("obs_id", "baseline")


def _realtime(v) -> DataFrame:
    model, _, test = _trained(v, M.REALTIME, "final_delay_mins")
    scored = model.transform(M.vectors(test, M.REALTIME))
    parts = [_measures(M.measured(scored, "prediction", "final_delay_mins"), "model"), _measures(M.measured(test, "current_delay_mins", "final_delay_mins"), "persistence")]
    parts.append(_rows(v.spark, [("importance", n, x) for _, n, x in M.importances(model, M.REALTIME)]))
    return reduce(DataFrame.unionByName, parts)


def _statistic(v) -> DataFrame:
    newest = v.observations.groupBy(*KEY).agg(F.max("recorded_at").alias("newest"))
    return L.trimmed_mean(v.observations, KEY).join(newest, KEY)


def _asked(v) -> DataFrame:
    """Every row as a train to be scored: one in three has no live reading, one in four no train before it."""
    rows = _encoded(v, keep=True)
    live, before = F.when(C("obs_id") % 3 > 0, C("delay_mins")), F.when(C("obs_id") % 4 > 0, C("preceding_delay_mins").cast("int"))
    return rows.withColumns({"reported": live, "preceding": before})


def _scores(v) -> DataFrame:
    asked = cut(_asked(v), "asked")
    fit, held = asked.filter("part = 'fit'"), asked.filter("part = 'validation'")
    day = M.train(fit, held, M.DAY_AHEAD, "delay_mins", trees=10)
    run = M.train(fit, held, M.REALTIME, "final_delay_mins", trees=10)
    return M.score(asked, _statistic(v), run, day, KEY, "2024-01-31 00:00:00").select("obs_id", "predicted", "confidence", "path")


def _synthetic(v) -> DataFrame:
    kind = F.when(C("obs_id") % 5 == 0, "bad").when(C("obs_id") % 2 == 0, "good").otherwise("average")
    return v.observations.select(F.concat(F.lit("g"), (C("obs_id") % 3).cast("string")).alias("generation"), kind.alias("day_type"), "delay_mins")


def _weighted(v) -> DataFrame:
    fit = M.tiered(v.observations, "delay_mins").select("obs_id", "delay_mins", "weight")
    pool = v.observations.filter("delay_mins <= 0").select((C("obs_id") + 1_000_000_000).alias("obs_id"), "delay_mins", F.lit(1.0).alias("weight"))
    return M.augmented(fit, pool, 200, 0.25)


_FEATURES = """
WITH o AS (SELECT *, CAST(recorded_at AS DATE) AS service_date, date_trunc('hour', recorded_at) AS hour FROM observations),
r AS (
  SELECT a.obs_id, count(b.obs_id) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '7' DAY) AS n7, count(b.obs_id) AS n14,
    avg(b.delay_mins) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '7' DAY) AS m7, stddev_pop(b.delay_mins) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '7' DAY) AS s7,
    avg(CASE WHEN b.delay_mins <= 0 THEN 100.0 ELSE 0.0 END) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '7' DAY) AS o7,
    avg(b.delay_mins) AS m14, stddev_pop(b.delay_mins) AS s14
  FROM o a LEFT JOIN o b ON b.uid = a.uid AND b.weekday = a.weekday AND b.origin_crs = a.origin_crs AND b.recorded_at >= a.recorded_at - INTERVAL '14' DAY
    AND b.recorded_at < date_trunc('day', a.recorded_at) GROUP BY a.obs_id),
p AS (
  SELECT a.obs_id, arg_max(CASE WHEN b.uid = a.uid THEN 0 ELSE b.delay_mins END, (b.recorded_at, b.obs_id)) FILTER (b.recorded_at >= a.recorded_at - INTERVAL '20' MINUTE) AS prior,
    avg(b.delay_mins) AS congestion
  FROM o a JOIN o b ON b.origin_crs = a.origin_crs AND b.recorded_at < a.recorded_at AND b.recorded_at >= a.recorded_at - INTERVAL '30' MINUTE GROUP BY a.obs_id),
h AS (SELECT uid[1] AS prefix, hour + INTERVAL '1' HOUR AS hour, avg(delay_mins) AS cascade FROM o GROUP BY 1, hour HAVING count(*) >= 3),
g AS (SELECT *, (departure_hour - (hour(recorded_at) + minute(recorded_at) / 60.0)) * 60.0 AS gap FROM o),
x AS (
  SELECT g.obs_id, g.uid, g.origin_crs, g.weekday, g.departure_hour, service_date, CAST(month(recorded_at) AS INTEGER) AS month,
    CASE WHEN departure_hour IN (7, 8, 16, 17, 18) AND weekday < 5 THEN 1 ELSE 0 END AS is_peak, coalesce(m7, 0.0) AS rolling_mean_7d, coalesce(s7, 0.0) AS rolling_std_7d,
    coalesce(o7, 0.0) AS rolling_ontime_7d, ln(1 + n7) AS sample_count_log, coalesce(m14, 0.0) AS rolling_mean_14d, coalesce(s14, 0.0) AS rolling_std_14d,
    CAST(delay_mins AS DOUBLE) AS current_delay_mins, CAST(coalesce(prior, 0) AS DOUBLE) AS preceding_delay_mins, CAST(coalesce(wind, 0) AS DOUBLE) AS wind_mph,
    CASE WHEN coalesce(wind, 0) <= 20 THEN 0 WHEN wind <= 35 THEN 1 WHEN wind <= 50 THEN 2 ELSE 3 END AS volatility_score,
    CAST(greatest(-360.0, least(360.0, CASE WHEN gap < -720 THEN gap + 1440 ELSE gap END)) AS DOUBLE) AS mins_until_departure, coalesce(congestion, 0.0) AS station_congestion_30m,
    coalesce(cascade, 0.0) AS operator_cascade_delay, CAST(coalesce(prior, 0) AS DOUBLE) AS predecessor_train_delay,
    last_value(delay_mins) OVER j AS final_delay_mins, g.obs_id = last_value(g.obs_id) OVER j AS is_journey_final
  FROM g JOIN r USING (obs_id) LEFT JOIN p USING (obs_id) LEFT JOIN h ON h.prefix = uid[1] AND h.hour = g.hour LEFT JOIN weather_hourly w ON w.hour = g.hour
  WINDOW j AS (PARTITION BY g.uid, g.weekday, g.origin_crs, service_date ORDER BY recorded_at, g.obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
"""

LIST = [
    ("engineer_features", lambda v: _engineered(v).select("obs_id", *_PLAIN), _FEATURES + "SELECT obs_id, " + ", ".join(_PLAIN) + " FROM x"),
    ("day_ahead_vector", lambda v: M.vectors(_encoded(v)).select("obs_id", "part", *M.vector_columns(None)), _FEATURES + """,
     t AS (SELECT service_date, row_number() OVER (ORDER BY service_date DESC) AS back, count(*) OVER () AS n FROM (SELECT DISTINCT service_date FROM x) q),
     b AS (SELECT *, least(n - 1, greatest(1, CAST(round_even(n * 0.15, 0) AS INTEGER))) AS last FROM t),
     d AS (SELECT service_date, CASE WHEN back <= last THEN 'test' WHEN back <= last + least(n - last - 1, greatest(1, CAST(round_even((n - last) * (0.1 / 0.85), 0) AS INTEGER)))
       THEN 'validation' ELSE 'fit' END AS part FROM b),
     f AS (SELECT x.*, part FROM x JOIN d USING (service_date)),
     e AS (SELECT DISTINCT origin_crs, dense_rank() OVER (ORDER BY origin_crs) AS code FROM f WHERE part = 'fit'),
     u AS (SELECT prefix, avg(rolling_mean_7d) AS m, dense_rank() OVER (ORDER BY prefix) AS code FROM (SELECT uid[1] AS prefix, rolling_mean_7d FROM f WHERE part = 'fit') q GROUP BY prefix),
     k AS (SELECT DISTINCT weekday || '_' || uid[1] AS wd, dense_rank() OVER (ORDER BY weekday || '_' || uid[1]) AS code FROM f WHERE part = 'fit')
     SELECT obs_id, part, CAST(weekday AS DOUBLE) AS weekday, CAST(departure_hour AS DOUBLE) AS departure_hour, CAST(month AS DOUBLE) AS month, CAST(is_peak AS DOUBLE) AS is_peak,
       CAST(coalesce(e.code, 0) AS DOUBLE) AS origin_crs_enc, CAST(coalesce(u.code, 0) AS DOUBLE) AS uid_prefix_enc, rolling_mean_7d, rolling_std_7d, rolling_ontime_7d, sample_count_log,
       rolling_mean_14d, rolling_std_14d, CAST(coalesce(k.code, 0) AS DOUBLE) AS weekday_operator_enc, rolling_mean_7d - coalesce(u.m, 0.0) AS operator_relative_delay
     FROM f LEFT JOIN e USING (origin_crs) LEFT JOIN u ON prefix = uid[1] LEFT JOIN k ON wd = weekday || '_' || uid[1]"""),
    ("augment_union", _weighted, """
     WITH o AS (SELECT obs_id, delay_mins, CASE WHEN delay_mins <= 0 THEN 0 WHEN delay_mins <= 5 THEN 1 WHEN delay_mins <= 30 THEN 2 ELSE 3 END AS tier FROM observations),
     c AS (SELECT tier, count(*) AS c FROM o GROUP BY tier),
     w AS (SELECT tier, (SELECT sum(c) FROM c) / ((SELECT count(*) FROM c) * c) AS weight FROM c)
     SELECT obs_id, delay_mins, CAST(weight AS DOUBLE) AS weight, FALSE AS is_synthetic FROM o JOIN w USING (tier)
     UNION ALL SELECT * FROM (SELECT obs_id + 1000000000 AS obs_id, delay_mins, CAST(0.25 AS DOUBLE) AS weight, TRUE AS is_synthetic FROM o WHERE delay_mins <= 0
       ORDER BY md5('42:' || (obs_id + 1000000000)), obs_id LIMIT 200) q"""),
    ("synthetic_stats", lambda v: T.synthetic_stats(_synthetic(v)), """
     WITH s AS (SELECT 'g' || (obs_id % 3) AS generation, CASE WHEN obs_id % 5 = 0 THEN 'bad' WHEN obs_id % 2 = 0 THEN 'good' ELSE 'average' END AS day_type, delay_mins AS d FROM observations)
     SELECT generation, count(*) AS total_rows, count(*) FILTER (day_type = 'good') AS good_rows, count(*) FILTER (day_type = 'average') AS average_rows,
       coalesce(avg(d) FILTER (day_type = 'good'), 0) AS avg_delay_good, coalesce(avg(d) FILTER (day_type = 'average'), 0) AS avg_delay_average,
       coalesce(100.0 * avg(CAST(d <= 0 AS INTEGER)) FILTER (day_type = 'good'), 0) AS ontime_pct_good,
       coalesce(100.0 * avg(CAST(d <= 0 AS INTEGER)) FILTER (day_type = 'average'), 0) AS ontime_pct_average
     FROM s GROUP BY generation ORDER BY generation DESC LIMIT 1"""),
    ("score_statistic", lambda v: M.score(_asked(v), _statistic(v), key=KEY, as_of="2024-03-01 00:00:00").select("obs_id", "predicted", "confidence", "path"), _FEATURES + """,
     n AS (SELECT *, row_number() OVER (PARTITION BY uid, weekday, origin_crs ORDER BY recorded_at DESC, obs_id DESC) AS age FROM observations),
     i AS (SELECT *, count(*) OVER q AS n, row_number() OVER (q ORDER BY delay_mins, obs_id) AS k FROM n WHERE age <= 90 WINDOW q AS (PARTITION BY uid, weekday, origin_crs)),
     z AS (SELECT uid, weekday, origin_crs, CAST(trunc(sum(delay_mins) / count(*)) AS INTEGER) AS mean, any_value(n) / 90.0 AS trust FROM i
       WHERE n >= 3 AND k > least(n // 10, (n - 1) // 2) AND k <= n - least(n // 10, (n - 1) // 2) GROUP BY 1, 2, 3),
     l AS (SELECT uid, weekday, origin_crs, date_diff('second', max(recorded_at), TIMESTAMP '2024-03-01') / 86400.0 AS age FROM observations GROUP BY 1, 2, 3),
     y AS (SELECT obs_id, mean, trust, age, CASE WHEN obs_id % 4 > 0 THEN CAST(preceding_delay_mins AS INTEGER) END AS before
       FROM x LEFT JOIN z USING (uid, weekday, origin_crs) LEFT JOIN l USING (uid, weekday, origin_crs))
     SELECT obs_id, CASE WHEN before IS NULL THEN mean ELSE CAST(round(0.6 * mean + 0.4 * before) AS INTEGER) END AS predicted,
       CASE WHEN mean IS NOT NULL THEN CAST(CASE WHEN age > 21 THEN trust * exp(-age / 21.0) ELSE trust END AS DOUBLE) END AS confidence,
       CASE WHEN mean IS NOT NULL THEN 'statistic' END AS path FROM y"""),
    ("baseline_of_later_dates", lambda v: _later(v), """
     WITH o AS (SELECT *, recorded_at < TIMESTAMP '2024-01-25' AS early FROM observations),
     r AS (SELECT *, row_number() OVER (PARTITION BY uid, weekday, origin_crs, departure_hour ORDER BY delay_mins, obs_id) AS pos,
       count(*) OVER (PARTITION BY uid, weekday, origin_crs, departure_hour) AS n FROM o WHERE early),
     t AS (SELECT *, greatest(1, n // 10) AS k FROM r),
     m AS (SELECT uid, weekday, origin_crs, departure_hour, avg(delay_mins) AS mean_delay FROM t WHERE n <= 2 * k OR pos BETWEEN k + 1 AND n - k GROUP BY 1, 2, 3, 4)
     SELECT obs_id, coalesce(mean_delay, (SELECT avg(delay_mins) FROM o WHERE early)) AS baseline
     FROM o LEFT JOIN m USING (uid, weekday, origin_crs, departure_hour) WHERE NOT early"""),
    ("train_day_ahead", _day_ahead, None),
    ("train_realtime", _realtime, None),
    ("score_cascade", _scores, None),
]
