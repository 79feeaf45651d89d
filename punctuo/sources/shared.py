"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in the folder that ``spark.checkpoint.dir`` names.  A local session that names none
    gets a temporary folder; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="punctuo-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lineage cut that outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def recut(df: DataFrame, name: str, before: DataFrame | None) -> DataFrame:
    """:func:`cut` of a round of a search, after which the cut of the round ``before`` is deleted, as no step reads it again."""
    found = cut(df, name)
    if before is not None:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(before.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return found


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name`` made once a row, however often it is used: a filter on what :meth:`withColumn` makes is
    pushed below it with a copy of its expression, which for a parser means parsing again; none is pushed below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))
