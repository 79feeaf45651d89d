"""Report aggregates: every function takes DataFrames and parameters and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from punctuo.functions import scalars as S

def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def recent(df: DataFrame, as_of: str, hours: int, time_col: str = "recorded_at", delay_col: str | None = "delay_mins") -> DataFrame:
    """Rows of the last ``hours`` (open lower bound) with a sane delay; both predicates reach the scan."""
    out = df.filter(F.col(time_col) > at(as_of) - F.expr(f"INTERVAL '{hours}' HOUR"))
    return out.filter(S.sane(F.col(delay_col))) if delay_col else out


def _observed() -> list[Column]:
    d, p = F.col("delay_mins"), F.col("predicted_delay_mins")
    return [
        S.on_time_pct(d, 0).alias("on_time_pct"), F.avg(d.cast("double")).alias("mean_delay"),
        S.mae(p, d).alias("mae"), F.count(F.lit(1)).alias("n"),
    ]


def headline_metrics(obs: DataFrame, as_of: str, hours: int) -> DataFrame:
    return recent(obs, as_of, hours).agg(*_observed())


def daily_series(obs: DataFrame, as_of: str, hours: int) -> DataFrame:
    return recent(obs, as_of, hours).groupBy(S.london_day(F.col("recorded_at")).alias("day")).agg(*_observed())


def trend_delta(series: DataFrame, value: str) -> DataFrame:
    """Last minus first of a daily series; null with fewer than two points."""
    ends = F.max_by(value, "day") - F.min_by(value, "day")
    return series.agg(F.when(F.count(F.lit(1)) >= 2, ends).alias("delta"))


def journey_metrics(journeys: DataFrame, as_of: str, hours: int) -> DataFrame:
    a, r = F.col("arrival_delay_mins"), F.col("recovered_mins")
    return recent(journeys, as_of, hours, "finalised_at", "arrival_delay_mins").agg(
        S.on_time_pct(a, 5).alias("on_time_pct"),
        F.avg(a.cast("double")).alias("mean_delay"),
        (100.0 * F.avg(F.when(r >= 2, 1.0).otherwise(0.0))).alias("recovered_pct"),
        F.avg(F.when(r > 0, r.cast("double"))).alias("mean_recovered"),
        F.count(F.lit(1)).alias("n"),
    )


def coverage_counts(**tables: DataFrame) -> DataFrame:
    """Row counts side by side: one union of one-row aggregates, pivoted by condition."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, df in tables.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in tables])


def best_delay() -> Column:
    return F.coalesce("arrival_delay_mins", "origin_delay_mins")


def _with_prediction(journeys: DataFrame, outcomes: DataFrame) -> DataFrame:
    slim = outcomes.select("rid", F.col("predicted_delay_mins").alias("p"), F.col("final_delay_mins").alias("f"))
    return journeys.join(slim, "rid", "left")


def _journeyed() -> list[Column]:
    return [
        S.on_time_pct(best_delay(), 5).alias("on_time_pct"), F.avg(best_delay().cast("double")).alias("mean_delay"),
        S.mae(F.col("p"), F.col("f")).alias("mae"), F.count(F.lit(1)).alias("n"),
    ]


def _operated(journeys: DataFrame, as_of: str, hours: int, toc: str | None = None) -> DataFrame:
    """Journeys finalised in the last ``hours`` with a sane delay, of one operator or of any."""
    rows = recent(journeys, as_of, hours, "finalised_at", None).filter(S.sane(best_delay()))
    return rows.filter(F.col("toc") == toc if toc else F.col("toc") != "")


def operator_league(
    journeys: DataFrame, operators: DataFrame, outcomes: DataFrame, as_of: str, hours: int, least: int, top: int
) -> DataFrame:
    found = _with_prediction(_operated(journeys, as_of, hours), outcomes).groupBy("toc").agg(*_journeyed())
    found = found.filter(F.col("n") >= least).join(operators, "toc", "left")
    return found.select(
        "toc", F.coalesce("name", "toc").alias("name"), F.coalesce("brand_color", F.lit(S.GREY)).alias("brand_color"),
        "on_time_pct", "mean_delay", "mae", "n",
    ).orderBy(F.col("on_time_pct").desc_nulls_last(), "toc").limit(top)


def operator_detail(journeys: DataFrame, outcomes: DataFrame, toc: str, as_of: str, hours: int) -> DataFrame:
    return _with_prediction(_operated(journeys, as_of, hours, toc), outcomes).agg(*_journeyed())


def operator_daily_series(journeys: DataFrame, toc: str, as_of: str, hours: int) -> DataFrame:
    rows = _operated(journeys, as_of, hours, toc).groupBy(S.london_day(F.col("finalised_at")).alias("day"))
    return rows.agg(
        S.on_time_pct(best_delay(), 5).alias("on_time_pct"), F.avg(best_delay().cast("double")).alias("mean_delay"),
        F.count(F.lit(1)).alias("n"),
    )


def operator_delay_distribution(journeys: DataFrame, toc: str, as_of: str, hours: int) -> DataFrame:
    """Bands 0, 1, 6, 16, 31, 61 by their least delay; upper ends belong to a band."""
    label = S.band(best_delay(), (0, 5, 15, 30, 60), True, 0, (1, 6, 16, 31, 61))
    return _operated(journeys, as_of, hours, toc).groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def operator_routes(journeys: DataFrame, toc: str, as_of: str, hours: int, top: int) -> DataFrame:
    rows = _operated(journeys, as_of, hours, toc).groupBy("origin_tpl", "destination_tpl")
    found = rows.agg(
        S.on_time_pct(best_delay(), 5).alias("on_time_pct"), F.avg(best_delay().cast("double")).alias("mean_delay"),
        F.count(F.lit(1)).alias("n"),
    )
    return found.orderBy(F.col("mean_delay").desc_nulls_last(), "origin_tpl", "destination_tpl").limit(top)


def operator_highlights(
    journeys: DataFrame, operators: DataFrame, as_of: str, hours: int, least: int = 20, top: int = 6
) -> DataFrame:
    """No sanity filter; a journey without a delay counts as late."""
    late = F.avg(F.when(best_delay() <= 5, 1.0).otherwise(0.0))
    rows = recent(journeys, as_of, hours, "scheduled_departure", None).filter("toc <> ''").groupBy("toc")
    found = rows.agg((100.0 * late).alias("on_time_pct"), F.count(F.lit(1)).alias("n"))
    found = found.filter(F.col("n") >= least).join(operators, "toc", "left")
    found = found.select("toc", F.coalesce("name", "toc").alias("name"), "on_time_pct", "n")
    return found.orderBy(F.col("on_time_pct").desc(), "toc").limit(top)


def _finalised(outcomes: DataFrame, as_of: str | None = None, hours: int = 0) -> DataFrame:
    """Outcomes with a sane final delay, of the last ``hours`` if ``as_of`` is given."""
    outcomes = recent(outcomes, as_of, hours, "finalised_at", None) if as_of else outcomes
    return outcomes.filter(F.col("final_delay_mins").isNotNull() & S.sane(F.col("final_delay_mins")))


def calibration_curve(outcomes: DataFrame, as_of: str, hours: int) -> DataFrame:
    p, f = F.col("predicted_delay_mins"), F.col("final_delay_mins")
    label = S.band(p, (0, 5, 15, 30, 60), True, 0, (1, 6, 16, 31, 61)).alias("band")
    return _finalised(outcomes, as_of, hours).groupBy(label).agg(
        F.avg(p.cast("double")).alias("mean_predicted"), F.avg(f.cast("double")).alias("mean_actual"),
        F.count(F.lit(1)).alias("n"),
    )


def confidence_error(outcomes: DataFrame, as_of: str, hours: int) -> DataFrame:
    c = F.col("prediction_confidence")
    label = F.least(F.floor(c * 5), F.lit(4)).cast("int").alias("band")
    rows = _finalised(outcomes, as_of, hours).filter(c.isNotNull()).groupBy(label)
    return rows.agg(S.mae(F.col("predicted_delay_mins"), F.col("final_delay_mins")).alias("mae"), F.count(F.lit(1)).alias("n"))


def error_distribution(outcomes: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Bands of actual minus predicted; upper ends belong to the next band."""
    error = F.col("final_delay_mins") - F.col("predicted_delay_mins")
    label = S.band(error, (-15, -5, -2, 2, 5, 15), False, -999, (-15, -5, -2, 2, 5, 15))
    return _finalised(outcomes, as_of, hours).groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _accuracy() -> list[Column]:
    p, f = F.col("predicted_delay_mins"), F.col("final_delay_mins")
    return [
        S.mae(p, f).alias("mae"), F.avg(p.cast("double")).alias("mean_predicted"),
        F.avg(f.cast("double")).alias("mean_actual"), F.count(F.lit(1)).alias("n"),
    ]


def accuracy_over_time(outcomes: DataFrame, as_of: str, hours: int) -> DataFrame:
    return _finalised(outcomes, as_of, hours).groupBy(S.london_day(F.col("finalised_at")).alias("day")).agg(*_accuracy())


def accuracy_summary(outcomes: DataFrame, as_of: str, hours: int) -> DataFrame:
    gap = F.col("final_delay_mins") - F.col("predicted_delay_mins")
    return _finalised(outcomes, as_of, hours).agg(
        *_accuracy(), F.sum(F.when(F.abs(gap) <= 5, 1).otherwise(0)).alias("within_5"),
        F.avg(gap.cast("double")).alias("bias"),
    )


def leadtime_accuracy(snapshots: DataFrame, outcomes: DataFrame, as_of: str, hours: int) -> DataFrame:
    snapshots = recent(snapshots, as_of, hours, "snapshotted_at", None)
    final = _finalised(outcomes).select("rid", "scheduled_departure", "final_delay_mins")
    lead = (S.seconds(F.col("scheduled_departure")) - S.seconds(F.col("snapshotted_at"))) / 60
    label = S.band(lead, (15, 30, 60, 120), False, 0, (15, 30, 60, 120)).alias("band")
    rows = snapshots.join(final, "rid").groupBy(label)
    return rows.agg(S.mae(F.col("predicted_delay_mins"), F.col("final_delay_mins")).alias("mae"), F.count(F.lit(1)).alias("n"))


def busiest_origins(obs: DataFrame, as_of: str, hours: int, top: int) -> DataFrame:
    d = F.col("delay_mins")
    rows = recent(obs, as_of, hours).groupBy("origin_crs")
    found = rows.agg(F.count(F.lit(1)).alias("n"), S.on_time_pct(d, 0).alias("on_time_pct"), F.avg(d.cast("double")).alias("mean_delay"))
    return found.orderBy(F.col("n").desc(), "origin_crs").limit(top)


def station_summary(obs: DataFrame, as_of: str, hours: int, crs: str) -> DataFrame:
    rows = recent(obs, as_of, hours).filter(F.col("origin_crs") == crs)
    return rows.agg(*_observed(), F.stddev_samp(F.col("delay_mins").cast("double")).alias("std"))


def station_heatmap(obs: DataFrame, as_of: str, hours: int, crs: str) -> DataFrame:
    rows = recent(obs, as_of, hours).filter(F.col("origin_crs") == crs).groupBy("weekday", "departure_hour")
    return rows.agg(F.avg(F.col("delay_mins").cast("double")).alias("mean_delay"), F.count(F.lit(1)).alias("n"))


def station_busiest_services(obs: DataFrame, services: DataFrame, as_of: str, hours: int, crs: str, top: int) -> DataFrame:
    d = F.col("delay_mins")
    rows = recent(obs, as_of, hours).filter(F.col("origin_crs") == crs).groupBy("uid")
    found = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(d.cast("double")).alias("mean_delay"),
        F.stddev_samp(d.cast("double")).alias("std"), S.on_time_pct(d, 0).alias("on_time_pct"),
    )
    label = F.when(F.col("std") < 3, "steady").when(F.col("std") < 8, "variable").otherwise("erratic")
    found = found.join(services, "uid", "left").withColumn("reliability", label)
    return found.orderBy(F.col("n").desc(), "uid").limit(top)


def _since(obs: DataFrame, since: str) -> DataFrame:
    return obs.filter((F.col("recorded_at") >= at(since)) & S.sane(F.col("delay_mins")))


def report_summary(obs: DataFrame, since: str) -> DataFrame:
    d, p = F.col("delay_mins"), F.col("predicted_delay_mins")
    near = lambda m: 100.0 * F.avg(F.when(F.abs(d - p) <= m, 1.0).when(p.isNotNull(), 0.0))
    return _since(obs, since).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat_ws("|", "uid", "origin_crs")).alias("services"),
        F.avg(d.cast("double")).alias("mean_delay"), F.avg(p.cast("double")).alias("mean_predicted"),
        S.mae(p, d).alias("mae"), (100.0 * F.avg(F.when(p.isNotNull(), 1.0).otherwise(0.0))).alias("coverage_pct"),
        S.on_time_pct(d, 0).alias("on_time_pct"), near(5).alias("within_5_pct"), near(10).alias("within_10_pct"),
    )


def report_daily(obs: DataFrame, since: str) -> DataFrame:
    return _since(obs, since).groupBy(F.to_date("recorded_at").alias("day")).agg(*_observed())


def report_hourly(obs: DataFrame, since: str) -> DataFrame:
    rows = _since(obs, since).groupBy("departure_hour")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("delay_mins").cast("double")).alias("mean_delay"))


def report_services(obs: DataFrame, since: str, top: int = 100) -> DataFrame:
    key = ["uid", "weekday", "origin_crs", "departure_hour"]
    share = 100.0 * F.avg(F.when(F.col("predicted_delay_mins").isNotNull(), 1.0).otherwise(0.0))
    found = _since(obs, since).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("delay_mins").cast("double")).alias("mean_delay"), share.alias("coverage_pct")
    )
    return found.orderBy(F.col("n").desc(), *key).limit(top)


def showcase_kpis(obs: DataFrame, as_of: str, hours: int) -> DataFrame:
    d, p = F.col("delay_mins"), F.col("predicted_delay_mins")
    near = 100.0 * F.avg(F.when(F.abs(d - p) <= 5, 1.0).when(p.isNotNull(), 0.0))
    return recent(obs, as_of, hours).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("services"),
        S.on_time_pct(d, 5).alias("on_time_pct"), S.mae(p, d).alias("mae"), near.alias("within_5_pct"),
    )


def map_day_operators(journeys: DataFrame, least: int = 25, top: int = 14) -> DataFrame:
    found = journeys.filter("toc is not null").groupBy("toc").agg(S.on_time_pct(best_delay(), 5).alias("pct"), F.count(F.lit(1)).alias("n"))
    found = found.filter(F.col("n") >= least).select("toc", F.round("pct").cast("int").alias("on_time_pct"), "n")
    return found.orderBy(F.col("n").desc(), "toc").limit(top)


def map_day_hourly(journeys: DataFrame) -> DataFrame:
    late = 100.0 * F.avg(F.when(best_delay() > 5, 1.0).when(best_delay().isNotNull(), 0.0))
    hour = F.hour("scheduled_departure").alias("hour")
    return journeys.filter(best_delay().isNotNull()).groupBy(hour).agg(late.alias("late_pct"), F.count(F.lit(1)).alias("n"))


def map_day_about(journeys: DataFrame, calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    gap = F.col("final_delay_mins") - F.col("predicted_delay_mins")
    j = journeys.agg(
        F.count(F.lit(1)).alias("journeys"), F.round(S.on_time_pct(best_delay(), 5)).cast("int").alias("on_time_pct"),
        F.count_distinct("toc").alias("operators"),
    )
    o = _finalised(outcomes).agg(
        F.count(F.lit(1)).alias("predictions"), F.round(F.avg(F.abs(gap).cast("double")), 1).alias("mae"),
        F.round(100.0 * F.avg(F.when(F.abs(gap) <= 5, 1.0).otherwise(0.0))).cast("int").alias("within_5_pct"),
    )
    one = F.lit(1).alias("__one")  # one row each
    c = calls.agg(F.count(F.lit(1)).alias("calls")).select("*", one)
    return j.select("*", one).join(o.select("*", one), "__one").join(c, "__one").drop("__one")


def recent_counts(journeys: DataFrame, timetable: DataFrame, as_of: str, hours: int) -> DataFrame:
    today = timetable.filter(F.col("operating_date") == F.to_date(at(as_of)))
    return coverage_counts(journeys=recent(journeys, as_of, hours, "finalised_at", None), timetable=today)


def data_by_day(obs: DataFrame) -> DataFrame:
    rows = obs.groupBy(F.to_date("recorded_at").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("delay_mins").cast("double")).alias("mean_delay"))


def reason_accuracy(outcomes: DataFrame, reasons: DataFrame) -> DataFrame:
    """Verdicts by whether the prediction was within 5 minutes and by the class of the recorded reason (rid, code)."""
    rows = _finalised(outcomes).join(reasons, "rid", "left").withColumn("cls", S.reason_class(F.col("code")))
    hit = F.abs(F.col("final_delay_mins") - F.col("predicted_delay_mins")) <= 5
    verdict = (
        F.when(hit & (F.col("cls") == 1), "earned").when(hit & (F.col("cls") == 2), "coincidental").when(hit, "clean")
        .when(F.col("cls") == 2, "explained_miss").when(F.col("cls") == 1, "model_error").otherwise("unexplained")
    )
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def recent_predictions(outcomes: DataFrame, top: int) -> DataFrame:
    cols = ("rid", "uid", "origin_crs", "predicted_delay_mins", "final_delay_mins")
    return outcomes.orderBy(F.col("predicted_at").desc(), "rid").limit(top).select(*cols)


def recent_settled(outcomes: DataFrame, services: DataFrame, operators: DataFrame, top: int) -> DataFrame:
    rows = outcomes.filter("final_delay_mins is not null").orderBy(F.col("finalised_at").desc(), "rid").limit(top)
    rows = rows.join(services.select("uid", "toc"), "uid", "left").join(operators, "toc", "left")
    return rows.select("rid", "uid", "toc", F.coalesce("name", "toc").alias("operator"), "predicted_delay_mins", "final_delay_mins")


def replay_candidates(outcomes: DataFrame, top: int) -> DataFrame:
    rows = _finalised(outcomes).filter("predicted_delay_mins <> 0 and destination_crs is not null")
    rows = rows.orderBy(F.col("scheduled_departure").desc(), "rid").limit(top)
    return rows.select("rid", "origin_crs", "destination_crs", "predicted_delay_mins", "final_delay_mins")


def explore(
    obs: DataFrame, services: DataFrame, group: str, as_of: str, hours: int | None, hour_range=(0, 23),
    weekdays: tuple[int, ...] = (), toc: str | None = None, min_delay: int | None = None, limit: int = 200,
) -> DataFrame:
    """The guided query over observations: clamped inputs, optional predicates, one grouping, all metrics.

    Services are joined only where the operator or destination is used.  The global group is one row even if empty.
    """
    low, high = (min(23, max(0, h)) for h in hour_range)
    days = tuple(d for d in weekdays if 0 <= d <= 6)
    rows = recent(obs, as_of, hours) if hours else obs.filter(S.sane(F.col("delay_mins")))
    rows = rows.filter(F.col("departure_hour").between(low, high))
    if days:
        rows = rows.filter(F.col("weekday").isin(*days))
    if min_delay is not None:
        rows = rows.filter(F.col("delay_mins") >= min_delay)
    if toc or group in ("operator", "destination"):
        rows = rows.join(services, "uid", "left")
    if toc:
        rows = rows.filter(F.col("toc") == toc)
    key = {
        "none": F.lit("all"), "operator": F.coalesce("toc", F.lit("?")), "destination": F.coalesce("destination_crs", F.lit("?")),
        "origin": F.col("origin_crs"), "uid": F.col("uid"), "hour": S.hour_label(F.col("departure_hour")),
        "weekday": S.weekday_name(F.col("weekday")), "day": F.date_format(S.london_day(F.col("recorded_at")), "yyyy-MM-dd"),
    }[group]
    d, p = F.col("delay_mins"), F.col("predicted_delay_mins")
    metrics = [
        F.count(F.lit(1)).alias("n"), F.avg(d.cast("double")).alias("mean_delay"), S.on_time_pct(d, 0).alias("on_time_pct"),
        F.percentile(d, F.lit(0.5)).alias("p50"), F.percentile(d, F.lit(0.9)).alias("p90"), S.mae(p, d).alias("mae"),
    ]
    if group == "none":
        return rows.agg(*metrics).select(F.lit("all").alias("label"), "*")
    found = rows.groupBy(key.alias("label")).agg(*metrics)
    return found.orderBy(F.col("n").desc(), "label").limit(min(500, max(1, limit)))


def observation_list(obs: DataFrame, services: DataFrame, limit: int) -> DataFrame:
    rows = obs.orderBy(F.col("recorded_at").desc(), "obs_id").limit(limit)
    return rows.join(services, "uid", "left").select(
        "obs_id", "uid", "toc", S.weekday_name(F.col("weekday")).alias("day"), S.hour_label(F.col("departure_hour")).alias("hour"),
        F.date_format("recorded_at", "yyyy-MM-dd HH:mm").alias("recorded"), "delay_mins",
    )


def stride_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows at floor(i * len / n) of the ordered list, or all if fewer; the list is a bounded top list."""
    w = Window.orderBy(*order)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    rows = df.withColumn("__r", F.row_number().over(w) - 1).withColumn("__t", total)
    i = F.ceil(F.col("__r") * n / F.col("__t"))
    pick = (F.col("__t") <= n) | (F.floor(i * F.col("__t") / n) == F.col("__r"))
    return rows.filter(pick).drop("__r", "__t")
