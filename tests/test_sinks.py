"""Sinks write each key once, replace only touched partitions, and exports read back."""

import pytest

from punctuo.sources import sinks

KIND = "uid string, day string, at int, delay int"
KEY, ORDER = ["uid", "day"], ["at"]


def read(spark, path):
    return sorted(tuple(r) for r in spark.read.schema(KIND).parquet(path).select("uid", "day", "at", "delay").collect())


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "1", 2, 5), ("a", "1", 1, 7), ("b", "1", 1, None), (None, "2", 1, 3)], KIND)
    want = [("a", "1", 1, 7), ("b", "1", 1, None)]
    sinks.append_once(rows.filter("uid is not null"), path, KEY, "day", ORDER)
    assert read(spark, path) == want
    sinks.append_once(rows, path, KEY, "day", ORDER)
    sinks.append_once(rows, path, KEY, "day", ORDER)
    got = spark.read.schema(KIND).parquet(path)
    assert got.count() == 3 and got.filter("uid is null").count() == 1
    sinks.append_once(spark.createDataFrame([], KIND), path, KEY, "day", ORDER)
    assert spark.read.schema(KIND).parquet(path).count() == 3


def test_partition_must_be_in_key(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.append_once(spark.createDataFrame([], KIND), str(tmp_path / "t"), ["uid"], "day", ORDER)


def test_stream_batches_repeat_safely(spark, tmp_path):
    source, path = str(tmp_path / "s"), str(tmp_path / "t")
    spark.createDataFrame([("a", "1", 1, 7), ("b", "1", 1, 2)], KIND).write.parquet(source)
    for turn in ("x", "y"):  # the second stream has no memory of the first
        write = sinks.once_per_batch(path, KEY, "day", ORDER)
        stream = spark.readStream.schema(KIND).parquet(source).writeStream.foreachBatch(write)
        stream.option("checkpointLocation", str(tmp_path / turn)).trigger(availableNow=True).start().awaitTermination()
    assert read(spark, path) == [("a", "1", 1, 7), ("b", "1", 1, 2)]


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([("a", "1", 1, 1), ("a", "2", 1, 1)], KIND), path, "day")
    sinks.replace_partitions(spark.createDataFrame([("b", "2", 1, 2)], KIND), path, "day")
    assert read(spark, path) == [("a", "1", 1, 1), ("b", "2", 1, 2)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([('say "x", y', None), ("b", 2)], "name string, n int")
    sinks.export_csv(df, str(tmp_path / "c"))
    sinks.export_json(df, str(tmp_path / "j"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted(r["name"] for r in back.collect()) == ["b", 'say "x", y']
    back = spark.read.json(str(tmp_path / "j"))
    assert sorted((r["name"], r["n"]) for r in back.collect()) == [("b", 2), ('say "x", y', None)]
