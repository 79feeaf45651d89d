"""Left joins to the reference tables, range joins between trains, and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S


def with_operator(rows: DataFrame, operators: DataFrame) -> DataFrame:
    """``rows`` with the name of their operator, null where it is unknown."""
    return rows.join(operators.select("toc", F.col("name").alias("operator_name")), "toc", "left")


def busiest_day(observations: DataFrame) -> DataFrame:
    """The observations of the UTC date with most of them; ties to the earlier date."""
    day = F.to_date("recorded_at")
    top = observations.groupBy(day.alias("day")).count().orderBy(F.desc("count"), "day").limit(1).select("day")
    return observations.withColumn("day", day).join(F.broadcast(top), "day")  # one row


def trimmed_baseline(observations: DataFrame, pattern: list[str]) -> DataFrame:
    """Per pattern the mean delay without the floor(n / 10) (one at least) lowest and highest; all where none is left."""
    own = Window.partitionBy(*pattern)
    at = F.row_number().over(own.orderBy("delay_mins", "obs_id"))
    ranked = observations.select(*pattern, "delay_mins", at.alias("at"), F.count(F.lit(1)).over(own).alias("n"))
    trim = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    kept = ranked.filter((F.col("n") <= 2 * trim) | ((F.col("at") > trim) & (F.col("at") <= F.col("n") - trim)))
    return kept.groupBy(*pattern).agg(F.first("n").alias("n"), F.avg("delay_mins").alias("mean_delay"))


def with_baseline(rows: DataFrame, earlier: DataFrame, pattern: list[str]) -> DataFrame:
    """``rows`` with ``baseline``: the trimmed mean of their pattern among ``earlier`` rows, else the mean of all of those."""
    means = trimmed_baseline(earlier, pattern).select(*pattern, "mean_delay")
    every = earlier.agg(F.avg("delay_mins").alias("__all"))  # one row
    found = rows.join(means, pattern, "left").crossJoin(F.broadcast(every))
    return found.withColumn("baseline", F.coalesce("mean_delay", "__all")).drop("mean_delay", "__all")


def stop_pairs(calls: DataFrame, stations: DataFrame) -> DataFrame:
    """Adjacent calls of each journey among those at stations with coordinates."""
    located = calls.join(stations.filter("lat is not null and lon is not null").select("tpl"), "tpl")
    along = Window.partitionBy("rid").orderBy("seq")
    pairs = located.select(
        "rid", "seq", F.col("tpl").alias("from_tpl"), F.lead("tpl").over(along).alias("to_tpl"),
        F.lead("seq").over(along).alias("to_seq"),
    )
    return pairs.filter("to_tpl is not null")


def preceding_serving(outcomes: DataFrame, back_secs: int = 1200, least_secs: int = 60, over_mins: int = 5) -> DataFrame:
    """The delayed train that left the same origin last, between ``back_secs`` and ``least_secs`` before each train.

    Each train is a candidate in its own slot of ``back_secs`` and the next, so a task sorts one slot of an origin and a
    busy origin is many groups.  Ties go to the larger rid.
    """
    at = S.seconds(F.col("scheduled_departure")).cast("long")
    slot = F.floor(F.col("at") / back_secs)
    rows = outcomes.select("rid", "origin_crs", "final_delay_mins", at.alias("at")).withColumn("own", slot)
    rows = rows.withColumn("slot", F.explode(F.array("own", F.col("own") + 1)))
    window = Window.partitionBy("origin_crs", "slot").orderBy("at").rangeBetween(-back_secs, -least_secs)
    late = F.when(F.col("final_delay_mins") > over_mins, F.struct("at", "rid", "final_delay_mins"))
    rows = rows.withColumn("before", F.max(late).over(window)).filter("own = slot and before is not null")
    return rows.select(
        "rid", F.col("before.rid").alias("preceding_rid"), F.col("before.final_delay_mins").alias("preceding_delay")
    )


def location_cascade(calls: DataFrame, within_secs: int = 1200, over_mins: int = 5) -> DataFrame:
    """For each call over ``over_mins`` late: calls of other trains there within ``within_secs``, ends included.

    An equi-join on place and time slot; each call is dealt to its own slot and both neighbours.
    """
    at = S.seconds(F.col("sched_arr")).cast("long")
    base = calls.select("rid", "seq", "tpl", "arr_delay_mins", at.alias("at"))
    slot = F.floor(F.col("at") / within_secs)
    late = base.filter(F.col("arr_delay_mins") > over_mins).withColumn("slot", slot).alias("a")
    near = base.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1))).alias("b")
    on = (
        (F.col("a.tpl") == F.col("b.tpl"))
        & (F.col("a.slot") == F.col("b.slot"))
        & (F.col("a.rid") != F.col("b.rid"))
        & (F.abs(F.col("a.at") - F.col("b.at")) <= within_secs)
    )
    return late.join(near, on).select(
        F.col("a.rid").alias("source_rid"), F.col("a.seq").alias("source_seq"), F.col("b.rid").alias("rid"),
        F.col("b.seq").alias("seq"), F.col("a.arr_delay_mins").alias("delay_mins"),
    )


def evaluate(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: n, MAE, RMSE, bias (actual - predicted), and the shares within 2, 5 and 10 minutes."""
    error = actual - predicted
    share = [F.avg((F.abs("e") <= m).cast("double")).alias(f"within_{m}") for m in (2, 5, 10)]
    found = rows.select(error.cast("double").alias("e")).filter("e is not null")
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), *share,
    )
