"""Writes of the rail tables as partitioned Parquet, and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(found)


def append_once(new: DataFrame, path: str, key: list[str], partition: str, order: list[str]) -> None:
    """Append the rows whose key the table does not hold; of new rows with one key the first by ``order`` counts.

    ``partition`` is one of the key's columns, so only partitions that the new rows touch can hold their keys.  Null
    keys equal each other.  A repeated write of the same batch adds nothing.
    """
    if partition not in key:
        raise ValueError(f"{partition} is not part of the key")
    spark, columns = new.sparkSession, new.columns
    rest = [c for c in columns if c not in key and c not in order]
    first = new.groupBy(*key).agg(F.min(F.struct(*[c for c in order if c not in key], *rest)).alias("__f"))
    rows = first.select(*key, "__f.*").select(*columns)
    if _there(spark, path):
        old = spark.read.schema(new.schema).parquet(path).select(*key)
        old = old.join(rows.select(partition).distinct(), partition, "left_semi").alias("o")
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
        rows = rows.alias("n").join(old, same, "left_anti")
    rows.write.partitionBy(partition).mode("append").parquet(path)


def once_per_batch(path: str, key: list[str], partition: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """:func:`append_once` for ``foreachBatch``: a batch that is run again after a failure adds nothing twice."""
    return lambda batch, _: append_once(batch, path, key, partition, order)


def replace_partitions(new: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions (days, generations) that ``new`` has rows of; others stay as they are."""
    new.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header; quotes within a field are doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
