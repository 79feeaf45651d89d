"""Feed messages by hand, and scalar rules on malformed, null and wrapping values."""

import gzip

import pytest
from pyspark.sql import functions as F

from punctuo.functions import scalars as S
from punctuo.operators import live
from punctuo.sources import feed

RID = "202404171234567"


def test_messages_by_hand(spark):
    texts = [
        f'<Pport ts="2024-04-17T11:00:00"><uR><TS rid="{RID}" ssd="2024-04-17" uid="C12345"><Location tpl="LEEDS" ptd="12:00" plat="3">'
        '<dep et="12:07"/></Location><Location tpl="YORK" wta="12:30:30"/></TS></uR></Pport>',
        f'<a:Pport xmlns:a="x" ts="2024-04-17T11:05:00"><a:uR><a:deactivated rid="{RID}"/><a:TS rid="short" ssd="2024-04-17"/></a:uR></a:Pport>',
        "<Pport ts='2024", None, "",
    ]
    bodies = [gzip.compress(texts[0].encode()), texts[1].encode(), texts[2].encode(), None, b"\x1f\x8bbroken"]
    raw = feed.inflated(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(bodies)], "n int, body binary"))
    messages = feed.decoded(raw)
    row = feed.status(messages).collect()
    assert len(row) == 1
    assert (row[0]["rid"], row[0]["platform"], row[0]["origin_tpl"], row[0]["dest_tpl"]) == (RID, "3", "LEEDS", "YORK")
    assert str(row[0]["est_dep"]) == "2024-04-17 12:07:00"
    calls = feed.calls(messages).orderBy("seq").collect()
    assert [(c["tpl"], c["is_cancelled"], c["sched_arr"] and str(c["sched_arr"])) for c in calls] == [("LEEDS", False, None), ("YORK", False, "2024-04-17 12:30:30")]
    assert [r["rid"] for r in feed.deactivated(messages).collect()] == [RID]
    assert feed.associations(messages).count() == feed.reasons(messages).count() == 0


@pytest.mark.parametrize("code,kind", [(163, 1), (171, 1), (100, 2), (139, 2), (999, 0), (None, 0)])
def test_reason_class(spark, code, kind):
    assert spark.createDataFrame([(code,)], "c int").select(F.coalesce(S.reason_class(F.col("c")), F.lit(0))).first()[0] == kind


def test_scalar_rules(spark):
    rows = [("23:55", "00:05", None), ("00:05", "23:55", 3), ("25:99", "12:00", 6), (None, "bad", 1)]
    df = spark.createDataFrame(rows, "a string, b string, d int")
    stamp = lambda c: S.clock_parse(F.lit("2024-04-17").cast("date"), F.col(c))
    got = df.select(S.wrapped_delay(stamp("a"), stamp("b")), S.delay_band_live(F.col("d")), S.gtfs_clock(F.concat("a", F.lit(":00")))).collect()
    assert [tuple(r) for r in got] == [(10, "on_time", 86100), (-10, "minor", 300), (None, "late", None), (None, "on_time", None)]
    names = spark.createDataFrame([("London North Eastern Railway",), ("Northern",), ("Great Northern",), (None,)], "n string")
    assert [r[0] for r in names.select(S.brand_colour(F.col("n"))).collect()] == ["#ce0e2d", "#262262", "#1d1d4e", "#9aa7b4"]


def test_board_takes_the_first_live_train(spark):
    at = lambda t: F.to_timestamp(F.lit(f"2024-04-17 {t}"))
    planned = spark.createDataFrame([("LDS", "t1", 0)], "place string, trip_id string, call_order int").withColumn("departure", at("09:00:00"))
    live_trains = spark.createDataFrame([("LDS", "r1", 5), ("LDS", "r2", 7), ("YRK", "r3", 1)], "place string, rid string, delay_mins int")
    shift = F.when(F.col("rid") == "r1", F.expr("INTERVAL '110' SECOND")).otherwise(F.expr("INTERVAL '-120' SECOND"))
    got = live.departure_board(planned, live_trains.withColumn("departure", at("09:00:00") + shift)).collect()
    assert {(r["place"], r["rid"], r["delay_mins"], r["planned"]) for r in got} == {("LDS", "r2", 7, True), ("YRK", "r3", 1, False)}
