"""Sums over sliding times, from running sums.

A frame between two moving bounds is added up anew for every row, so a group costs its rows times the rows of its frames.  What
lies between two times is the running sum before the later less that before the earlier, and a running sum is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S


def sums_before(rows: DataFrame, key: list[str], times: dict[str, tuple[Column, int]], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with ``<sum>_<name>`` for each of ``times`` (name: time, back; longs) and ``sums`` (of longs): the sum over the
    rows of the key whose ``time`` is more than ``back`` before the row's own.

    All frames begin where the key begins and end at a fixed distance from the row, so each row is added once a frame; no row is
    copied, and one shuffle by the key serves all frames.
    """
    for name, (time, back) in times.items():
        before = Window.partitionBy(*key).orderBy(time).rangeBetween(Window.unboundedPreceding, -back - 1)
        rows = rows.withColumns({f"{n}_{name}": F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    return rows


def in_slots(obs: DataFrame, within_s: int) -> DataFrame:
    """``obs`` in its own time slot of ``within_s`` (``__own`` = ``__slot``) and, as look-back rows, in the next, so that neither
    a long history nor a hot origin is one group."""
    slot = F.floor(S.seconds(F.col("recorded_at")) / within_s)
    return obs.withColumn("__own", slot).withColumn("__slot", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))


def last_before(slotted: DataFrame, within_s: int, out: str) -> DataFrame:
    """:func:`in_slots` rows with the last strictly earlier row (t, i, u, d) at the origin, null where it is more than
    ``within_s`` earlier; of rows at one time the largest obs_id counts.  The slots must be of ``within_s`` or wider."""
    at = S.micros(F.col("recorded_at"))
    before = Window.partitionBy("origin_crs", "__slot").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    row = F.struct(F.col("recorded_at").alias("t"), F.col("obs_id").alias("i"), F.col("uid").alias("u"), F.col("delay_mins").alias("d"))
    rows = slotted.withColumn(out, F.max(row).over(before))
    return rows.withColumn(out, F.when(S.micros(F.col(f"{out}.t")) >= at - within_s * 1_000_000, F.col(out)))


def mean_before(slotted: DataFrame, within_s: int, out: str) -> DataFrame:
    """:func:`in_slots` rows with the mean delay at the origin over ``within_s`` before, 0 where there is none.  The slots must
    be of ``within_s`` or wider."""
    at, d = S.micros(F.col("recorded_at")), F.col("delay_mins").cast("long")
    times = {"own": (at, 0), "from": (at, within_s * 1_000_000)}
    rows = sums_before(slotted, ["origin_crs", "__slot"], times, {"__s": d, "__n": d.isNotNull().cast("long")})
    n = F.col("__n_own") - F.col("__n_from")
    mean = (F.col("__s_own") - F.col("__s_from")) / F.nullif(n, F.lit(0))
    return rows.withColumn(out, F.coalesce(mean, F.lit(0.0))).drop(*[f"__{x}_{t}" for x in "sn" for t in ("from", "own")])
