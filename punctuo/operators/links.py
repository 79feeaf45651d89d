"""Joins, windows and features over the rail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S
from punctuo.operators import frames


def direct_journeys(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (from_crs, to_crs): services that call at both in that order on one day.  An equi-join on (uid, day,
    trip) with the order as its residual; ``pairs`` cut both sides first, so only calls at asked stations are shuffled.
    Whether ``pairs`` are broadcast is left to Spark, which goes by their size."""
    start = calls.join(pairs, F.col("location_crs") == F.col("from_crs"), "left_semi").alias("a")
    stop = calls.join(pairs, F.col("location_crs") == F.col("to_crs"), "left_semi").alias("b")
    key = ["uid", "operating_date", "trip_id"]
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("b.call_order") > F.col("a.call_order")]
    both = start.join(stop, on).select(
        "a.uid", "a.operating_date", "a.trip_id", F.col("a.location_crs").alias("from_crs"),
        F.col("b.location_crs").alias("to_crs"), F.col("a.dep_secs").alias("dep_secs"), F.col("b.dep_secs").alias("arr_secs"),
    )
    return both.join(pairs, ["from_crs", "to_crs"], "left_semi")


def convergence(snapshots: DataFrame, outcomes: DataFrame, rid: str | None = None) -> DataFrame:
    """Every snapshot of finalised trains (or of one train) against its outcome, largest lead first."""
    final = outcomes.filter("finalised_at is not null").select("rid", "scheduled_departure", "final_delay_mins")
    rows = snapshots.filter(F.col("rid") == rid).join(final, "rid") if rid else snapshots.join(final, "rid")
    lead = (S.seconds(F.col("scheduled_departure")) - S.seconds(F.col("snapshotted_at"))) / 60.0
    error = F.abs(F.col("final_delay_mins") - F.col("predicted_delay_mins"))
    found = rows.select("rid", lead.alias("lead_mins"), "predicted_delay_mins", "final_delay_mins", error.alias("abs_error"))
    return found.orderBy(F.desc("lead_mins")) if rid else found


def cheapest_fare(fares: DataFrame, day: str) -> DataFrame:
    """Per origin and destination the cheapest fare valid on ``day``; a null end is open; ties to the lower class."""
    valid = F.lit(day).cast("date").between(F.col("valid_from"), F.coalesce("valid_to", F.lit("2999-12-31").cast("date")))
    best = F.min(F.struct("price_pence", "class")).alias("b")
    rows = fares.filter(valid).groupBy("origin", "destination").agg(best)
    return rows.select("origin", "destination", "b.price_pence", "b.class")


def asof_preceding(obs: DataFrame, within_s: int = 1200) -> DataFrame:
    """Delay of the last strictly earlier row at the same origin within the window; 0 if there is none or it is of the
    same uid.  A running maximum by slots of time, not a join; of rows at one time the largest obs_id counts."""
    out = frames.last_before(frames.in_slots(obs, within_s), within_s, "p").filter("__own = __slot")
    own = F.coalesce(F.col("p.u") != F.col("uid"), F.lit(False))
    return out.select("obs_id", F.when(own, F.col("p.d")).otherwise(0).alias("preceding_delay"))


def station_congestion(obs: DataFrame, within_s: int = 1800) -> DataFrame:
    rows = frames.mean_before(frames.in_slots(obs, within_s), within_s, "congestion")
    return rows.filter("__own = __slot").select("obs_id", "congestion")


def operator_cascade(obs: DataFrame, least: int = 3) -> DataFrame:
    """Mean delay of the uid prefix in the hour before, 0 unless ``least`` rows: an hourly aggregate shifted and joined."""
    hour, prefix = F.date_trunc("hour", "recorded_at"), F.substring("uid", 1, 5)
    rows = obs.select("obs_id", hour.alias("hour"), prefix.alias("prefix"), "delay_mins")
    means = rows.groupBy("prefix", "hour").agg(F.avg(F.col("delay_mins").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    means = means.filter(F.col("n") >= least).select("prefix", (F.col("hour") + F.expr("INTERVAL '1' HOUR")).alias("hour"), "m")
    return rows.join(means, ["prefix", "hour"], "left").select("obs_id", F.coalesce("m", F.lit(0.0)).alias("cascade"))


def history_ring(obs: DataFrame, key: list[str], cap: int = 90) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col("recorded_at").desc(), F.col("obs_id").desc())
    return obs.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= cap)


def trimmed_mean(obs: DataFrame, key: list[str], cap: int = 90, least: int = 3) -> DataFrame:
    """Serving prediction: integer mean, truncated toward zero, of the newest rows less a tenth at each end."""
    ring = history_ring(obs, key, cap)
    w = Window.partitionBy(*key)
    ranked = ring.withColumn("n", F.count(F.lit(1)).over(w))
    ranked = ranked.withColumn("r", F.row_number().over(w.orderBy("delay_mins", "obs_id")))
    trim = F.least(F.floor(F.col("n") / 10), F.floor((F.col("n") - 1) / 2))
    kept = ranked.filter((F.col("n") >= least) & (F.col("r") > trim) & (F.col("r") <= F.col("n") - trim))
    found = kept.groupBy(*key).agg(F.sum("delay_mins").alias("s"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    return found.select(*key, F.expr("s div k").cast("int").alias("predicted"), (F.col("n") / float(cap)).alias("confidence"))


def rolling_training(obs: DataFrame, key: list[str], days: int, long: int = 14) -> DataFrame:
    """Count, mean, deviation, percentage on time and log count over [t - days, start of t's day), and mean and deviation over
    [t - long, ...), as what runs up to the one less what runs up to the other.  The long window counts where the other is empty."""
    t, d = S.micros(F.col("recorded_at")), F.col("delay_mins").cast("long")
    times = {x: (t, n * 86_400_000_000) for x, n in (("from", days), ("long", long))} | {"day": (S.micros(F.date_trunc("day", "recorded_at")), 0)}
    rows = frames.sums_before(obs, key, times, {"n": F.lit(1).cast("long"), "s": d, "q": d * d, "o": (d <= 0).cast("long")})
    rows = rows.select("obs_id", *[(F.col(f"{x}_day") - F.col(f"{x}_{w}")).alias(f"{x}_{w}") for x in "nsqo" for w in ("from", "long")])

    def stats(w: str) -> tuple[Column, Column]:
        n = F.nullif(F.col(f"n_{w}"), F.lit(0))
        mean = F.col(f"s_{w}") / n
        return F.coalesce(mean, F.lit(0.0)), F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{w}") / n - mean * mean)), F.lit(0.0))

    (mean, std), (mean_long, std_long) = stats("from"), stats("long")
    on_time = F.coalesce(100.0 * F.col("o_from") / F.nullif(F.col("n_from"), F.lit(0)), F.lit(0.0))
    return rows.select(
        "obs_id", F.col("n_from").alias("n"), mean.alias("mean"), std.alias("std"), on_time.alias("on_time"), F.log1p(F.col("n_from").cast("double")).alias("log_n"),
        mean_long.alias(f"mean_{long}"), std_long.alias(f"std_{long}"),
    )


def final_label(obs: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key, F.to_date("recorded_at"))
    last = F.row_number().over(w.orderBy(F.col("recorded_at").desc(), F.col("obs_id").desc()))
    label = F.max_by("delay_mins", F.struct("recorded_at", "obs_id")).over(w)
    return obs.select("obs_id", label.alias("label"), (last == 1).alias("is_final"))


def stop_pairs(calls: DataFrame, stations: DataFrame) -> DataFrame:
    """Adjacent located calls of a journey."""
    located = calls.join(stations.filter("lat is not null").select("tpl", "lat", "lon"), "tpl")
    w = Window.partitionBy("rid").orderBy("seq")
    nxt = {c: F.lead(c).over(w).alias(f"next_{c}") for c in ("tpl", "lat", "lon", "arr_delay_mins")}
    return located.select("rid", "seq", "tpl", "lat", "lon", *nxt.values()).filter("next_tpl is not null")


def edge_stats(calls: DataFrame, stations: DataFrame, longest_km: float = 40.0) -> DataFrame:
    """Undirected edges between stops: mean delay at the second stop, count from 2 capped at 999, colour band."""
    pairs = stop_pairs(calls, stations).filter("tpl <> next_tpl")
    pairs = pairs.filter(S.grid_km(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")) < longest_km)
    rows = pairs.groupBy(F.least("tpl", "next_tpl").alias("a"), F.greatest("tpl", "next_tpl").alias("b"))
    found = rows.agg(F.avg(F.col("next_arr_delay_mins").cast("double")).alias("mean_delay"), F.count(F.lit(1)).alias("c"))
    found = found.filter("c >= 2")
    return found.select("a", "b", "mean_delay", F.least("c", F.lit(999)).alias("n"), S.delay_band_edge(F.col("mean_delay")).alias("band"))


def weather_join(obs: DataFrame, weather: DataFrame) -> DataFrame:
    rows = obs.withColumn("hour", F.date_trunc("hour", "recorded_at")).join(weather, "hour", "left")
    wind = F.coalesce("wind", F.lit(0))
    return rows.select("obs_id", wind.alias("wind"), S.wind_level_training(wind).alias("wind_level"))


def first_prediction(snapshots: DataFrame) -> DataFrame:
    """The earliest prediction of each rid; ties to the smaller prediction.  Aggregates before it shuffles."""
    first = F.min(F.struct("snapshotted_at", "predicted_delay_mins")).alias("f")
    return snapshots.groupBy("rid").agg(first).select("rid", F.col("f.predicted_delay_mins").alias("predicted_delay_mins"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_null: list[str]) -> DataFrame:
    """New columns win; those in ``keep_if_null`` keep the old value where the new one is null."""
    n, o = new.alias("n"), old.alias("o")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    here = F.col(f"n.{key}").isNotNull()
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in old.columns:
        if c != key:
            fresh = F.coalesce(f"n.{c}", f"o.{c}") if c in keep_if_null else F.col(f"n.{c}")
            out.append(F.when(here, fresh).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def temporal_split(obs: DataFrame, fraction: float = 0.2) -> DataFrame:
    """The last max(1, round(fraction * dates)) dates are the later part; dates are few and ordered as one list."""
    days = obs.select(F.to_date("recorded_at").alias("day")).distinct()
    back = F.row_number().over(Window.orderBy(F.col("day").desc()))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    cut = F.greatest(F.lit(1), F.bround(total * fraction, 0).cast("int"))
    return days.select("day", F.when(back <= cut, "later").otherwise("earlier").alias("part"))


def tier_weights(obs: DataFrame) -> DataFrame:
    tier = S.band(F.col("delay_mins"), (0, 5, 30), True, 0, (1, 2, 3)).alias("tier")
    counts = obs.groupBy(tier).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # at most four rows
    return counts.select("tier", "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))
