"""The departure board, names, turnrounds and the timetable build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S


def route_filter(calls: DataFrame, watched: list[str]) -> DataFrame:
    """Trains that call at a watched place; none watched keeps all."""
    if not watched:
        return calls.select("rid").distinct()
    return calls.filter(F.col("tpl").isin(*watched)).select("rid").distinct()


def turnround_delay(associations: DataFrame, delays: DataFrame) -> DataFrame:
    """Per next_rid the previous train of its last association (prev_rid, seen_at) and that train's delay (rid, delay_mins)."""
    last = associations.groupBy("next_rid").agg(F.max(F.struct("seen_at", "prev_rid")).alias("a"))
    last = last.select("next_rid", F.col("a.prev_rid").alias("prev_rid"))
    return last.join(delays.select(F.col("rid").alias("prev_rid"), "delay_mins"), "prev_rid", "left")


def resolved_names(trains: DataFrame, code: str, by_crs: DataFrame, by_tiploc: DataFrame) -> DataFrame:
    """``trains`` with ``name``: codes of three characters go by CRS, others by TIPLOC; null where unknown."""
    crs, tpl = by_crs.toDF("__crs", "__by_crs"), by_tiploc.toDF("__tpl", "__by_tpl")
    short = F.length(code) == 3
    out = trains.join(crs, short & (F.col(code) == F.col("__crs")), "left").join(tpl, ~short & (F.col(code) == F.col("__tpl")), "left")
    return out.withColumn("name", F.coalesce("__by_crs", "__by_tpl")).drop("__crs", "__by_crs", "__tpl", "__by_tpl")


def live_departures(calls: DataFrame) -> DataFrame:
    """Trains by the place they start at: place, rid, departure (time), delay_mins."""
    start = calls.filter("seq = 0 and sched_dep is not null")
    return start.select(F.upper("tpl").alias("place"), "rid", F.col("sched_dep").alias("departure"), F.col("dep_delay_mins").alias("delay_mins"))


def departure_board(timetable: DataFrame, live: DataFrame, within_s: int = 120) -> DataFrame:
    """Planned departures (place, trip_id, call_order, departure) with the first live train within ``within_s`` seconds.

    An interval join: both sides are dealt into slots of ``within_s`` and a planned row meets its own and both next slots.
    Ties go to the earlier live departure, then the smaller rid.  Live trains at places without any planned row follow.
    """
    slot = F.floor(F.unix_seconds(F.col("departure").cast("timestamp")) / within_s)
    held = live.select("place", F.col("rid").alias("live_rid"), F.col("departure").alias("live_at"), F.col("delay_mins").alias("live_delay"), slot.alias("slot"))
    asked = timetable.withColumn("own", slot).withColumn("slot", F.explode(F.array(*[F.col("own") + k for k in (-1, 0, 1)])))
    gap = F.unix_seconds(F.col("live_at").cast("timestamp")) - F.unix_seconds(F.col("departure").cast("timestamp"))
    met = asked.join(held, ["place", "slot"]).filter(F.abs(gap) <= within_s)
    first = met.groupBy("place", "trip_id", "call_order", "departure").agg(F.min(F.struct("live_at", "live_rid", "live_delay")).alias("f"))
    board = timetable.join(first, ["place", "trip_id", "call_order", "departure"], "left").select(
        "place", "departure", "trip_id", "call_order", F.col("f.live_rid").alias("rid"), F.col("f.live_delay").alias("delay_mins"), F.lit(True).alias("planned")
    )
    alone = live.join(timetable.select("place").distinct(), "place", "left_anti").select(
        "place", "departure", F.lit(None).cast("string").alias("trip_id"), F.lit(None).cast("int").alias("call_order"),
        "rid", "delay_mins", F.lit(False).alias("planned"),
    )
    return board.unionByName(alone)


def search_names(queries: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """For each query the ``top`` names (code, name) of which a word starts with each of its tokens.

    Exact codes first, then names that start with the first token, then shorter names, then by name.
    """
    token = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: t != "")
    asked = queries.withColumn("__t", token(F.col("query"))).filter(F.size("__t") > 0)
    words = names.withColumn("__w", token(F.col("name")))
    # A name is found under every prefix of its words, so that the first token is an equi-join key.
    starts = F.flatten(F.transform("__w", lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.substr(w, F.lit(1), n))))
    words = words.withColumn("__first", F.explode(F.array_distinct(starts)))
    met = asked.withColumn("__first", F.get("__t", F.lit(0))).join(words, "__first")
    met = met.filter(F.forall("__t", lambda t: F.exists("__w", lambda w: w.startswith(t))))
    order = (
        (F.col("code") == F.upper(F.trim("query"))).desc(), F.lower("name").startswith(F.col("__first")).desc(),
        F.length("name"), F.col("name"), F.col("code"),
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return met.withColumn("place", place).filter(F.col("place") <= top).select("query", "place", "code", "name")


def replay(outcomes: DataFrame, journeys: DataFrame, start: str, end: str) -> DataFrame:
    """Finalised outcomes of a range of days that have a journey, in time order."""
    day = F.col("scheduled_departure").cast("date")
    rows = outcomes.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("final_delay_mins").isNotNull())
    return rows.join(journeys.select("rid", "n_calls"), "rid").orderBy("scheduled_departure", "rid").select(
        "rid", "scheduled_departure", "predicted_delay_mins", "final_delay_mins", "n_calls"
    )


def operator_of_uid(trips: DataFrame) -> DataFrame:
    """The operator of each uid: that of its first trip (by ``order``) that has one."""
    return trips.filter("toc is not null").groupBy("uid").agg(F.min_by("toc", "order").alias("toc"))


def build_services(trips: DataFrame, stops: DataFrame, known: DataFrame) -> DataFrame:
    """Per uid its first trip (uid, trip_id) with two stops (trip_id, seq, place) or more and both ends among ``known``."""
    ends = stops.groupBy("trip_id").agg(
        F.min_by("place", "seq").alias("origin"), F.max_by("place", "seq").alias("destination"), F.count(F.lit(1)).alias("n")
    )
    good = ends.filter("n >= 2").join(known.toDF("origin"), "origin", "left_semi").join(known.toDF("destination"), "destination", "left_semi")
    first = trips.join(good, "trip_id").groupBy("uid").agg(F.min(F.struct("trip_id", "origin", "destination")).alias("f"))
    return first.select("uid", "f.trip_id", "f.origin", "f.destination")


def expand_calls(stops: DataFrame, known: DataFrame, first_day: str, days: int = 7) -> DataFrame:
    """Stops of every trip on each of the next ``days``; order is the position; unknown places are skipped."""
    start = F.lit(first_day).cast("date")
    rows = stops.join(known.toDF("place"), "place", "left_semi")
    return rows.withColumn("operating_date", F.explode(F.sequence(start, F.date_add(start, days - 1)))).select(
        "trip_id", "operating_date", "place", F.col("seq").alias("call_order")
    )


def cancelled_journeys(calls: DataFrame) -> DataFrame:
    """Headers of trains all of whose calls are cancelled; their reason class is 0."""
    ends = calls.groupBy("rid").agg(
        F.bool_and("is_cancelled").alias("all"), F.min_by("tpl", "seq").alias("origin_tpl"), F.max_by("tpl", "seq").alias("destination_tpl")
    )
    return ends.filter("all").select("rid", "origin_tpl", "destination_tpl", F.lit(0).alias("reason_class"))


def station_snapshot(trains: DataFrame, stations: DataFrame, as_of: str) -> DataFrame:
    """Live trains by the station they start at: (place, rid, departure, estimated, delay_mins, platform, is_cancelled, secs_ago,
    destination, predicted).

    ``trains`` has rid, origin, destination, departure, estimated, reported, predicted, live_platform, planned_platform,
    is_cancelled and the times estimated_at, reported_at, platform_at, cancelled_at of its fields; ``stations`` has crs and
    tiploc.  The origin is a code or a tiploc, in capitals or not.  Best values are the live ones, else those predicted or
    planned; ``secs_ago`` is counted from the newest of the four times, and not below 0.
    """
    code = lambda c: F.nullif(F.upper(c), F.lit(""))
    codes = stations.select(F.col("crs").alias("place"), F.explode(F.array_distinct(F.array(code("crs"), code("tiploc")))).alias("code"))
    newest = F.greatest(*[S.seconds(F.col(c)) for c in ("estimated_at", "reported_at", "platform_at", "cancelled_at")])
    rows = trains.withColumn("code", F.upper("origin")).join(codes.filter("code is not null"), "code")
    return rows.select(
        "place", "rid", "departure", "estimated", F.coalesce("reported", "predicted").alias("delay_mins"), F.coalesce("live_platform", "planned_platform").alias("platform"),
        "is_cancelled", F.greatest(F.lit(0), S.seconds(F.lit(as_of)) - newest).alias("secs_ago"), "destination", "predicted",
    )


def station_board(timetable: DataFrame, live: DataFrame, names: DataFrame, within_s: int = 120) -> DataFrame:
    """Departures of all stations: planned ones (place, uid, call_order, departure, platform) with the first live train
    (:func:`station_snapshot`) within ``within_s`` seconds, and live ones of stations that have none planned.

    The live train's rid, delay, estimate, cancellation and platform win; a planned row without one goes by its uid, and its
    platform is marked as planned.  ``names`` (code, name) has names by crs and by tiploc; only planned rows are named, live
    ones alone keep their code.  Both sides are dealt into slots of ``within_s``; ties go to the smaller rid.
    """
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    slot = F.floor(at("departure") / within_s)
    fields = ["estimated", "delay_mins", "platform", "is_cancelled", "secs_ago", "destination", "predicted"]
    held = live.select("place", slot.alias("slot"), F.struct(F.col("departure").alias("live_at"), "rid", *fields).alias("l"))
    key = ["place", "uid", "call_order", "departure"]
    asked = timetable.select(*key).distinct().withColumn("slot", F.explode(F.array(*[slot + k for k in (-1, 0, 1)])))
    met = asked.join(held, ["place", "slot"]).filter(F.abs(at("l.live_at") - at("departure")) <= within_s)
    # Struct comparison looks at the departure and then at the rid, which is a train's own.
    first = met.groupBy(*key).agg(F.min_by("l", F.struct("l.live_at", "l.rid")).alias("l"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key]
    rows = timetable.alias("t").join(first.alias("f"), same, "left").select("t.*", "f.l")
    rows = rows.join(names.select(F.col("code").alias("__code"), F.col("name").alias("destination_name")), F.col("l.destination") == F.col("__code"), "left")
    board = rows.select(
        "place", "departure", F.coalesce("l.rid", F.trim("uid")).alias("rid"), "l.estimated", "l.delay_mins", F.coalesce("l.platform", "platform").alias("platform"),
        (F.col("l.platform").isNull() & F.col("platform").isNotNull()).alias("is_platform_planned"), "l.is_cancelled", "l.secs_ago", "destination_name", "l.predicted",
    )
    alone = live.join(timetable.select("place").distinct(), "place", "left_anti")
    return board.unionByName(alone.select(
        "place", "departure", "rid", "estimated", "delay_mins", "platform", F.lit(False).alias("is_platform_planned"), "is_cancelled", "secs_ago",
        F.col("destination").alias("destination_name"), "predicted",
    ))


def replay_sample(outcomes: DataFrame, journeys: DataFrame, names: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """Finalised outcomes of a range of days that have a journey, in time order, every so many of them so that at most ``most``
    are left: (place, rid, toc, origin, destination, scheduled_departure, predicted, final).

    ``names`` (tpl, code) has the display code of places; others show as they are.  A report's list: the order is one task's.
    """
    day = F.col("scheduled_departure").cast("date")
    rows = outcomes.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("final_delay_mins").isNotNull())
    rows = rows.join(journeys.select("rid", "toc", F.col("origin_tpl").alias("__o"), F.col("destination_tpl").alias("__d")), "rid")
    for column, out in (("__o", "origin"), ("__d", "destination")):
        code = names.select(F.col("tpl").alias(column), F.col("code").alias(out))
        rows = rows.join(code, column, "left").withColumn(out, F.coalesce(out, column))
    at = F.row_number().over(Window.orderBy("scheduled_departure", "rid")) - 1
    rows = rows.withColumns({"__at": at, "__n": F.count(F.lit(1)).over(Window.partitionBy())})
    # Row floor(i n / most) is the i-th: row r is one of them if the next multiple of n at or above r most is below (r + 1) most.
    place = F.ceil(F.col("__at") * most / F.col("__n")).cast("long")
    taken = (F.col("__n") <= most) | ((place < most) & (F.floor(place * F.col("__n") / most) == F.col("__at")))
    chosen = rows.filter(taken).withColumn("place", F.when(F.col("__n") <= most, F.col("__at")).otherwise(place))
    return chosen.select("place", "rid", F.coalesce("toc", F.lit("—")).alias("toc"), "origin", "destination", "scheduled_departure", "predicted_delay_mins", "final_delay_mins")
