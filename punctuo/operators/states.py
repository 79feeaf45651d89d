"""Train state, boards and upkeep as batch jobs: each is the twin of a fold over messages, told by aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S


def history_scan(obs: DataFrame, since: str, excluded: list[str], low: int, high: int) -> DataFrame:
    """Observations from ``since`` on, without the excluded days, with a delay in range; the filters reach the scan."""
    kept = obs.filter((F.col("recorded_at") >= F.lit(since).cast("timestamp")) & F.col("delay_mins").between(low, high))
    return kept.filter(~F.to_date("recorded_at").isin(*map(str, excluded))) if excluded else kept


def retention(rows: DataFrame, day: str, as_of: str, days: int) -> DataFrame:
    """Rows that stay: those of at most ``days`` days before ``as_of``.  Rows without a day go."""
    return rows.filter(F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), days))


def retention_counts(rows: DataFrame, day: str, as_of: str, days: int) -> DataFrame:
    stays = F.coalesce(F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False))
    return rows.agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("removed"))


def todays_calls(calls: DataFrame, as_of: str) -> DataFrame:
    at = F.lit(as_of).cast("timestamp")
    secs = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return calls.filter((F.col("operating_date") == F.to_date(at)) & (F.col("dep_secs") > secs))


def timetable_departures(calls: DataFrame) -> DataFrame:
    """Place of each call in its station's day, by departure, those without one last."""
    w = Window.partitionBy("location_crs", "operating_date")
    place = F.row_number().over(w.orderBy(F.asc_nulls_last("dep_secs"), "trip_id", "call_order"))
    return calls.select("location_crs", "operating_date", "trip_id", "call_order", place.alias("place"))


def located_ends(calls: DataFrame, stations: DataFrame) -> DataFrame:
    """Journeys of which both ends have coordinates."""
    ends = calls.groupBy("rid").agg(F.min_by("tpl", "seq").alias("origin"), F.max_by("tpl", "seq").alias("destination"))
    at = stations.filter("lat is not null and lon is not null").select("tpl", "lat", "lon")
    for end in ("origin", "destination"):
        ends = ends.join(at.select(F.col("tpl").alias(end), F.col("lat").cast("double").alias(f"{end}_lat"), F.col("lon").cast("double").alias(f"{end}_lon")), end)
    return ends.select("rid", "origin", "origin_lat", "origin_lon", "destination", "destination_lat", "destination_lon")


def wind_incident(obs: DataFrame, weather: DataFrame, over: int = 50) -> DataFrame:
    """Wind at the hour, 0 where none is known, and whether it is an incident."""
    rows = obs.withColumn("hour", F.date_trunc("hour", "recorded_at")).join(weather, "hour", "left")
    wind = F.coalesce("wind", F.lit(0))
    return rows.select("obs_id", wind.alias("wind"), (wind > over).alias("incident"))


def network_summary(journeys: DataFrame) -> DataFrame:
    """Counts of tracked, late and punctual journeys; those without an arrival are only tracked."""
    d = F.col("arrival_delay_mins")
    return journeys.agg(
        F.count(F.lit(1)).alias("tracked"), F.count_if(d > 0).alias("late"), F.count_if(d <= 0).alias("on_time"), F.max(d).alias("worst")
    )


def rolling_serving(obs: DataFrame, key: list[str], as_of) -> DataFrame:
    """Mean, population deviation, share on time and log count of 7 and 14 days before the day of ``as_of``; all zero
    where the 7 days are empty."""
    day = F.date_trunc("day", F.lit(as_of))
    t, d = F.col("recorded_at").cast("timestamp"), F.col("delay_mins").cast("double")
    rows, out = obs.filter((t < day) & (t >= day - F.expr("INTERVAL '14' DAY"))), []
    week = t >= day - F.expr("INTERVAL '7' DAY")
    for tag, inside in (("7", week), ("14", F.lit(True))):
        here = F.when(inside, d)
        out += [
            F.avg(here).alias(f"mean_{tag}"), F.stddev_pop(here).alias(f"std_{tag}"),
            F.avg(F.when(inside, (d <= 0).cast("double"))).alias(f"on_time_{tag}"), F.log1p(F.count(here)).alias(f"log_n_{tag}"),
        ]
    found = rows.groupBy(*key).agg(F.count(F.when(week, d)).alias("n"), *out)
    return found.select(*key, *[F.when(F.col("n") > 0, F.col(c)).otherwise(0.0).alias(c) for c in found.columns[len(key) + 1 :]])


def recent_mean_of_others(obs: DataFrame, group: list[str], as_of, minutes: int, least: int) -> DataFrame:
    """Mean delay of other rows of the group in the last minutes, 0 unless there are ``least``: sums less the own row."""
    since = F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    rows = obs.filter((F.col("recorded_at") >= since) & (F.col("recorded_at") <= F.lit(as_of)))
    sums = rows.groupBy(*group).agg(F.sum("delay_mins").alias("s"), F.count("delay_mins").alias("n"))
    own, one = F.coalesce("delay_mins", F.lit(0)), F.col("delay_mins").isNotNull().cast("long")
    mean = F.when(F.col("n") - one >= least, (F.col("s") - own) / F.nullif(F.col("n") - one, F.lit(0))).otherwise(0.0)
    return rows.join(sums, group).select("obs_id", mean.alias("mean_others"))


def first_seen_order(calls: DataFrame) -> DataFrame:
    """Sequence of the stations of a journey by first sighting; blank names do not count."""
    seen = calls.filter(F.trim("tpl") != "").groupBy("rid", "tpl").agg(F.min("seq").alias("first"))
    return seen.select("rid", "tpl", F.dense_rank().over(Window.partitionBy("rid").orderBy("first")).cast("int").alias("place"))


def tracking_board(outcomes: DataFrame, as_of: str, size: int = 24) -> DataFrame:
    """The next departures from five minutes before ``as_of`` on, soonest first (a top-k report)."""
    rows = outcomes.filter(F.col("scheduled_departure") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL '5' MINUTE"))
    rows = rows.filter("predicted_delay_mins is not null").orderBy("scheduled_departure", "rid").limit(size)
    return rows.select("rid", "scheduled_departure", "predicted_delay_mins")


def encodings(rows: DataFrame, column: str) -> DataFrame:
    """Codes 1..n of a category's sorted distinct values; the values are a dimension, ordered as one list."""
    values = rows.filter(F.col(column).isNotNull()).select(column).distinct()
    return values.select(column, F.row_number().over(Window.orderBy(column)).cast("int").alias("code"))


def encode(rows: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """The code of each row, 0 for values unseen when fitting."""
    return rows.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(0)))


def freshness(arrivals: DataFrame, source: str, at: str, as_of, stale_s: int = 300) -> DataFrame:
    lag = S.seconds(F.lit(as_of)) - S.seconds(F.max(at))
    state = F.when(lag.isNull(), "starting").when(lag > stale_s, "stale").otherwise("fresh")
    return arrivals.groupBy(source).agg(lag.alias("lag_s"), state.alias("state"))


def highest_version(rows: DataFrame, key: list[str], fields: list[str], version: str) -> DataFrame:
    """Each field from the row with the highest version that has it; ties to the larger value.  Partial aggregates
    meet before the shuffle, so a hot key costs one row a task."""
    best = [F.max(F.when(F.col(f).isNotNull(), F.struct(version, f)))[f].alias(f) for f in fields]
    return rows.groupBy(*key).agg(*best)


def build_journey(calls: DataFrame) -> DataFrame:
    """Header of each finished journey: delays at both ends, extremes over departure else arrival, what was recovered."""
    d = F.coalesce("dep_delay_mins", "arr_delay_mins")
    found = calls.groupBy("rid").agg(
        F.count(F.lit(1)).alias("n_calls"), F.min_by("dep_delay_mins", "seq").alias("origin_delay"),
        F.max_by("arr_delay_mins", "seq").alias("arrival_delay"), F.max(d).alias("max_delay"), F.min(d).alias("min_delay"),
        F.count_if("is_cancelled").alias("n_cancelled"),
    )
    whole, some = F.col("n_cancelled") == F.col("n_calls"), F.col("n_cancelled") > 0
    return found.withColumns({"recovered": F.col("max_delay") - F.col("arrival_delay"), "cancelled": whole, "partly": some & ~whole})


def origin_delay(calls: DataFrame) -> DataFrame:
    first = calls.filter("seq = 0")
    return first.select("rid", S.wrapped_delay(F.col("sched_dep"), F.coalesce("actual_dep", "actual_arr")).alias("mins"))


def evict_departed(trains: DataFrame, as_of: str, arrival: Column, departure: Column) -> DataFrame:
    """Trains that stay: the earlier of arrival and departure + 6 h is not over 300 s before ``as_of``."""
    gone = F.least(arrival, departure + F.expr("INTERVAL '6' HOUR"))  # nulls are passed over
    return trains.filter(gone >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL '300' SECOND"))


def finalised(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """First predictions with the first final delay of their train."""
    known = outcomes.filter("final_delay_mins is not null and finalised_at is not null")
    first = known.groupBy("rid").agg(F.min(F.struct("finalised_at", "final_delay_mins")).alias("f"))
    return predictions.join(first, "rid").select("rid", "predicted_delay_mins", F.col("f.final_delay_mins").alias("final_delay_mins"))


def cancellations(calls: DataFrame) -> DataFrame:
    """One row per cancelled train, at its first cancelled call, with weekday (0 = Monday) and hour."""
    first = calls.filter("is_cancelled").groupBy("rid").agg(F.min(F.struct("seq", "tpl", "sched_dep")).alias("c"))
    return first.select("rid", "c.tpl", F.weekday("c.sched_dep").alias("weekday"), F.hour("c.sched_dep").alias("hour"))


def calendar_mask(days: DataFrame, key: str, weekday: str) -> DataFrame:
    """Bits of the weekdays that a service runs on, bit 0 = Monday."""
    return days.groupBy(key).agg(F.bit_or(F.expr(f"shiftleft(1, {weekday})")).alias("mask"))


def synthetic_stats(rows: DataFrame) -> DataFrame:
    """Of the latest generation of synthetic history: rows, mean delay and share on time by type of day, 0 where there are none."""
    d, kinds = F.col("delay_mins").cast("double"), ("good", "average")
    is_ = lambda k: F.col("day_type") == k
    none = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.count(F.lit(1)).alias("total_rows"), *[F.count_if(is_(k)).alias(f"{k}_rows") for k in kinds]]
    out += [none(F.avg(F.when(is_(k), d))).alias(f"avg_delay_{k}") for k in kinds]
    out += [none(100.0 * F.avg(F.when(is_(k), (d <= 0).cast("double")))).alias(f"ontime_pct_{k}") for k in kinds]
    return rows.groupBy("generation").agg(*out).orderBy(F.col("generation").desc()).limit(1)


def merged_calls(seen: DataFrame, key: list[str], fields: list[str], version: str, sticky: str) -> DataFrame:
    """Stops as their messages leave them: each field from the newest row that has it; once ``sticky``, always so."""
    best = highest_version(seen, key, fields, version)
    return best.join(seen.groupBy(*key).agg(F.bool_or(F.coalesce(sticky, F.lit(False))).alias(sticky)), key)


def by_source(feed: DataFrame, poll: DataFrame, predictor: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Each field by the highest version among three sources: the feed's is its message time in milliseconds, a poll's its
    counter, a prediction's 0; so the feed wins over polls and these over predictions, whatever came last."""
    rows = feed.withColumn("version", F.unix_millis(F.col("seen_at").cast("timestamp"))).select(*key, *fields, "version")
    rows = rows.unionByName(poll.withColumn("version", F.col("counter").cast("long")).select(*key, *fields, "version"))
    rows = rows.unionByName(predictor.withColumn("version", F.lit(0).cast("long")).select(*key, *fields, "version"))
    return highest_version(rows, key, fields, "version")


def network_now(trains: DataFrame, calls: DataFrame, as_of: str, worst: int = 5) -> DataFrame:
    """Trains under way at ``as_of``: (kind, rid, value): their number, the cancelled, the late (over 0) and punctual ones,
    and the ``worst`` delays, ties by rid (a top-k report).

    A train (rid, delay_mins, is_cancelled) is under way from its departure to its arrival by the best known times of its
    first and last call; a cancelled train is neither late nor punctual.
    """
    at = S.seconds(F.lit(as_of))
    ends = calls.groupBy("rid").agg(
        F.min(F.struct("seq", F.coalesce("actual_dep", "sched_dep").alias("t"))).alias("f"), F.max(F.struct("seq", F.coalesce("actual_arr", "sched_arr").alias("t"))).alias("l")
    )
    ends = ends.filter((S.seconds(F.col("f.t")) <= at) & (S.seconds(F.col("l.t")) >= at)).select("rid")
    rows = trains.join(ends, "rid", "left_semi").withColumn("is_cancelled", F.coalesce("is_cancelled", F.lit(False)))
    runs, d = ~F.col("is_cancelled"), F.coalesce("delay_mins", F.lit(0))
    sums = {"tracked": F.lit(True), "cancelled": ~runs, "late": runs & (d > 0), "on_time": runs & (d <= 0)}
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in sums.items()])
    counts = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(None).cast("string").alias("rid"), F.col(n).alias("value")) for n in sums])))
    top = rows.filter(runs & (d > 0)).orderBy(d.desc(), "rid").limit(worst).select(F.lit("worst").alias("kind"), "rid", d.cast("long").alias("value"))
    return counts.unionByName(top)


def recent_mean_of_other_trains(obs: DataFrame, group: list[str], train: str, as_of, minutes: int, least: int) -> DataFrame:
    """For each row of the last minutes the mean delay of the *other trains* of its group in them, 0 unless these have
    ``least`` rows: the sums of the group less those of the train."""
    since = F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    rows = obs.filter((F.col("recorded_at") >= since) & (F.col("recorded_at") <= F.lit(as_of)))
    mine = rows.groupBy(*group, train).agg(F.sum("delay_mins").alias("ms"), F.count("delay_mins").alias("mn"))
    all_ = mine.groupBy(*group).agg(F.sum("ms").alias("s"), F.sum("mn").alias("n"))
    n = F.col("n") - F.col("mn")
    mean = F.when(n >= least, (F.col("s") - F.coalesce("ms", F.lit(0))) / F.nullif(n, F.lit(0))).otherwise(0.0)
    return rows.join(mine.join(all_, group).select(*group, train, mean.alias("mean_others")), [*group, train]).select("obs_id", "mean_others")


def next_departures(trains: DataFrame, as_of: str, size: int = 24) -> DataFrame:
    """The next departures of predicted trains that run, from five minutes before ``as_of`` on, soonest first (a top-k report)."""
    return tracking_board(trains.filter("not coalesce(is_cancelled, false)"), as_of, size)


def source_states(sources: DataFrame, arrivals: DataFrame, source: str, at: str, as_of, stale_s: int = 300) -> DataFrame:
    """Every source (source, enabled) by its silence: disabled, starting (nothing has come yet), fresh, or stale."""
    last = arrivals.groupBy(source).agg((S.seconds(F.lit(as_of)) - S.seconds(F.max(at))).alias("lag_s"))
    state = F.when(~F.col("enabled"), "disabled").when(F.col("lag_s").isNull(), "starting").when(F.col("lag_s") > stale_s, "stale").otherwise("fresh")
    rows = sources.join(last, source, "left").withColumn("state", state)
    return rows.select(source, "state", F.when(F.col("state").isin("fresh", "stale"), F.col("lag_s")).alias("lag_s"))
