"""Files of many stations and of large tables."""

import os

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import SMALL, oracle_sql, queries


def test_history_where_codes_of_stations_repeat(spark, tmp_path):
    """Past 26 ** 3 stations a code without a place in the list is also that of a later, known station."""
    for t in ("orders", "lineitem"):
        os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.range(1, 20001).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = queries()["history_json_to_observations"](spark, str(tmp_path)).count()
    db = duckdb.connect()
    for t in ("orders", "lineitem", "supplier"):
        path = f"{SMALL}/{t}.parquet" if t != "supplier" else f"{tmp_path}/supplier.parquet/*.parquet"
        db.execute(f"CREATE VIEW {t} AS FROM '{path}'")
    for t in ("customer", "part", "events", "nation", "region"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    assert got == db.execute(f"SELECT count(*) FROM ({oracle_sql()['history_json_to_observations']}) q").fetchone()[0] > 0


def test_large_tables_are_written_by_all_tasks(spark):
    from punctuo.plans import files
    from punctuo.views import Views

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for write in (files._catalog_file, files._trips_file, files._times_file):
            path = write(Views(spark, SMALL)).removeprefix("file://")
            assert sum(n.startswith("part-") for n in os.listdir(path)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
