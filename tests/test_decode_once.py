"""Messages are parsed once, whatever is asked of them; clocks are read from text."""

from pyspark.sql import functions as F

from punctuo.functions import scalars as S
from punctuo.sources import feed
from punctuo.sources import updates as U


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_xml")


def test_a_message_is_parsed_once(spark):
    raw = spark.range(1).selectExpr("id AS arrival_no", "CAST(id AS STRING) AS value")
    decoded = feed.decoded(raw)
    for found in (feed.status(decoded), feed.calls(decoded), feed.reasons(decoded), U.updates(U.messages(raw)), U.schedules(U.updates(U.messages(raw)))):
        assert parses(found) == 1


def test_clocks_at_the_edges(spark):
    texts = ["12:05", "23:59:59", "24:00", "12:60", "12:00:60", "1:00", "12:00:00\n", " 12:00", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", S.clock_parse(F.lit("2024-04-17").cast("date"), F.col("t")).alias("at")).orderBy("i").collect()
    assert [r["at"] and f"{r['at']:%H:%M:%S}" for r in got] == ["12:05:00", "23:59:59"] + [None] * 8
