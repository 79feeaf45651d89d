"""Calls are dealt into parts by the size of the input, so that a task's share does not grow with it."""

from pyspark.sql import functions as F

from punctuo import views
from punctuo.operators import states as T

SMALL = "/root/testdata/sf0.001"


def test_calls_are_dealt_by_size(spark, monkeypatch):
    v = views.Views(spark, SMALL)
    before = sorted(map(tuple, T.first_seen_order(v.journey_calls).collect()))
    assert "REPARTITION" not in v._dealt()
    monkeypatch.setattr(views, "PART_BYTES", v._size("lineitem") // 40)
    parts = v.journey_calls.groupBy(F.spark_partition_id()).count().count()
    assert parts > max(30, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert sorted(map(tuple, T.first_seen_order(v.journey_calls).collect())) == before
