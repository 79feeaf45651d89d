"""Folds and frames over ordered rows: the throttle of observations and the frames of a replay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S


def throttled(obs: DataFrame, key: list[str], least_change: int = 2, least_s: int = 300) -> DataFrame:
    """Readings that are kept: the first, and those that differ by ``least_change`` minutes or come ``least_s`` seconds after
    the last one *kept* of their key; ties in time are taken in the order of obs_id.

    A reading so long after the one before it is kept whatever was kept before, so rows are dealt by key and by such gaps,
    and a long history is no single group.  A task folds its rows in order and holds one of them.
    """
    at = S.micros(F.col("recorded_at"))
    own = Window.partitionBy(*key).orderBy(at, "obs_id")
    rows = obs.withColumn("__t", at).withColumn("__new", (F.col("__t") - F.lag("__t").over(own) >= least_s * 1_000_000).cast("int"))
    rows = rows.withColumn("__run", F.coalesce(F.sum("__new").over(own), F.lit(0))).drop("__new")
    dealt = [*key, "__run"]
    rows = rows.repartition(*dealt).sortWithinPartitions(*dealt, "__t", "obs_id")
    names = rows.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, delay, time = None, 0, 0
        for b in batches:
            kept = []
            cols = [b.column(names.index(c)).to_pylist() for c in (*dealt, "__t", "delay_mins")]
            for i, (*mine, t, d) in enumerate(zip(*cols, strict=True)):
                if mine != group or abs(d - delay) >= least_change or t - time >= least_s * 1_000_000:
                    group, delay, time = mine, d, t
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64()))

    return rows.filter("delay_mins is not null").mapInArrow(fold, rows.schema).drop("__t", "__run")


def frames(trains: DataFrame, group: list[str], order: list[str], tracking: int, settled: int) -> DataFrame:
    """Frames of a replay: (group, frame, side, place, rid).

    Trains of a group in order; frame i shows the next ``tracking`` trains from the i-th on, and the ``settled`` ones before
    it, the latest first.  Each train knows the frames it is in, so nothing is joined; a group is one replay's list.
    """
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    rows = trains.select(*group, "rid", at.alias("at"))
    ahead = F.transform(F.sequence(F.greatest(F.lit(0), F.col("at") - tracking + 1), F.col("at")), lambda i: F.struct(i.alias("frame"), F.lit("tracking").alias("side"), (F.col("at") - i).alias("place")))
    after = F.transform(F.sequence(F.col("at") + 1, F.col("at") + settled), lambda i: F.struct(i.alias("frame"), F.lit("settled").alias("side"), (i - 1 - F.col("at")).alias("place")))
    shown = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*group))).withColumn("x", F.explode(F.concat(ahead, after)))
    return shown.filter("x.frame <= n").select(*group, "x.frame", "x.side", "x.place", "rid")
