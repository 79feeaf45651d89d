"""The rail feed: XML messages to tables of train status, calls, ended trains, associations and reasons.

Every function takes and gives DataFrames, static or streaming.  A message that is no XML, or has no ``uR``, decodes to no
rows; :func:`counters` counts it.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctuo.functions import scalars as S
from punctuo.sources.shared import once

_REASON = "struct<_VALUE: int, _code: int, _tiploc: string>"
_TIMES = "struct<_et: string, _at: string>"
_CALL = (
    "struct<_tpl: string, _pta: string, _ptd: string, _wta: string, _wtd: string, _can: boolean, _plat: string, "
    f"arr: {_TIMES}, dep: {_TIMES}, plat: struct<_VALUE: string, _conf: boolean>>"
)
_STATUS = (
    "struct<_rid: string, _uid: string, _ssd: string, _can: boolean, _delayReason: int, _delayReasonTiploc: string, "
    f"_cancelReason: int, _cancelReasonTiploc: string, LateReason: {_REASON}, CancelReason: {_REASON}, Location: array<{_CALL}>>"
)
SCHEMA = (
    f"_ts string, uR struct<TS: array<{_STATUS}>, deactivated: array<struct<_rid: string>>, "
    "Association: array<struct<_category: string, main: struct<_rid: string>, assoc: struct<_rid: string>>>>"
)


def read_feed(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of the message files of a folder (value, arrived_at); ``.gz`` files are inflated by the reader."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_batch).load(path)
    return raw.select("value", F.current_timestamp().alias("arrived_at"))


def inflated(raw: DataFrame, body: str = "body") -> DataFrame:
    """``raw`` with ``value`` (string) for its binary ``body``: gzip is told by its first two bytes, other bytes pass.

    Null where the bytes can't be inflated or are no UTF-8.
    """

    def text(data: bytes | None) -> str | None:
        try:
            return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode() if data is not None else None
        except (OSError, EOFError, zlib.error, UnicodeDecodeError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [text(x) for x in b.column(b.schema.get_field_index(body)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string())], names=[*b.schema.names, "value"])

    return raw.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema) + ", value string")


def decoded(raw: DataFrame) -> DataFrame:
    """``raw`` (value, ...) with the message as ``m`` and its time as ``msg_ts``."""
    m = F.from_xml("value", SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return once(raw, "m", m).withColumn("msg_ts", F.try_to_timestamp(F.substring("m._ts", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def _trains(messages: DataFrame) -> DataFrame:
    rows = messages.select("msg_ts", F.explode("m.uR.TS").alias("t"))
    return rows.filter(S.valid_rid(F.col("t._rid"))).withColumn("ssd", F.to_date("t._ssd"))


def status(messages: DataFrame) -> DataFrame:
    """One row per train status: identity, cancellation, the first call's times and platform, first and last place."""
    first = F.get("t.Location", F.lit(0))
    clock = lambda c: S.clock_parse(F.col("ssd"), c)
    return _trains(messages).select(
        "msg_ts", F.col("t._rid").alias("rid"), F.col("t._uid").alias("uid"), "ssd",
        F.coalesce("t._can", F.lit(False)).alias("is_cancelled"),
        clock(first["_ptd"]).alias("sched_dep"), clock(first["_wtd"]).alias("work_dep"),
        clock(first["dep"]["_et"]).alias("est_dep"), clock(first["dep"]["_at"]).alias("act_dep"),
        F.coalesce(first["_plat"], first["plat"]["_VALUE"]).alias("platform"), first["_tpl"].alias("origin_tpl"),
        F.element_at("t.Location", -1)["_tpl"].alias("dest_tpl"), F.size("t.Location").alias("n_calls"),
    )


def calls(messages: DataFrame) -> DataFrame:
    """One row per stop of each train status: public time, else working time, for arrival and departure."""
    rows = _trains(messages).select("msg_ts", "ssd", F.col("t._rid").alias("rid"), F.posexplode("t.Location").alias("seq", "c"))
    clock = lambda *c: S.clock_parse(F.col("ssd"), F.coalesce(*map(F.col, c)))
    return rows.select(
        "msg_ts", "rid", "seq", F.col("c._tpl").alias("tpl"), clock("c._pta", "c._wta").alias("sched_arr"),
        clock("c._ptd", "c._wtd").alias("sched_dep"), clock("c.arr._et").alias("est_arr"), clock("c.arr._at").alias("act_arr"),
        clock("c.dep._et").alias("est_dep"), clock("c.dep._at").alias("act_dep"),
        F.coalesce("c._plat", "c.plat._VALUE").alias("platform"), F.col("c.plat._conf").alias("plat_confirmed"),
        F.coalesce("c._can", F.lit(False)).alias("is_cancelled"),
    )


def deactivated(messages: DataFrame) -> DataFrame:
    rows = messages.select("msg_ts", F.explode("m.uR.deactivated._rid").alias("rid"))
    return rows.filter(S.valid_rid(F.col("rid")))


def associations(messages: DataFrame) -> DataFrame:
    """Turnrounds (category NP) with both trains: prev_rid, next_rid."""
    rows = messages.select("msg_ts", F.explode("m.uR.Association").alias("a")).filter("a._category = 'NP'")
    found = rows.select("msg_ts", F.col("a.main._rid").alias("prev_rid"), F.col("a.assoc._rid").alias("next_rid"))
    return found.dropna(subset=["prev_rid", "next_rid"])


def reasons(messages: DataFrame) -> DataFrame:
    """Late and cancel reasons: code and place from the element's attributes or text, else from the train's attributes."""
    code = lambda e, a: F.coalesce(f"t.{e}._code", f"t.{e}._VALUE", f"t.{a}")
    rows = _trains(messages).select(
        "msg_ts", F.col("t._rid").alias("rid"), code("LateReason", "_delayReason").alias("late_code"),
        F.coalesce("t.LateReason._tiploc", "t._delayReasonTiploc").alias("late_tpl"),
        code("CancelReason", "_cancelReason").alias("cancel_code"),
        F.coalesce("t.CancelReason._tiploc", "t._cancelReasonTiploc").alias("cancel_tpl"),
    )
    return rows.filter("late_code is not null or cancel_code is not null")


def in_sequence(updates: DataFrame, key: str, time: str, arrival: str) -> DataFrame:
    """Updates whose time is strictly later than that of every earlier arrival of their train."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(time).over(before)
    return updates.withColumn("__last", last).filter(F.col("__last").isNull() | (F.col(time) > F.col("__last"))).drop("__last")


def counters(messages: DataFrame) -> DataFrame:
    """Messages by fate: applied, taxonomy (of no kind that is kept), parse_error."""
    fate = (
        F.when(S.message_class(F.col("value")) == "drop", "taxonomy").when(F.col("m.uR").isNull(), "parse_error").otherwise("applied")
    )
    return messages.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


def state_events(updates: DataFrame) -> DataFrame:
    """An Active to Critical event for every status of a cancelled or delayed train (rid, is_cancelled, delay_mins)."""
    hit = updates.filter(F.col("is_cancelled") | (F.col("delay_mins") > 0))
    return hit.select("rid", F.lit("Active").alias("from_state"), F.lit("Critical").alias("to_state"))
