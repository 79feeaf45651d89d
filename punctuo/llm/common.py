"""Shared pieces: text columns, lineage cuts through the shared folder, distributed ranks."""

from __future__ import annotations

import gc
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  A local session that names none (tests) gets a temporary one; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="punctuo-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives lost executors.

    Spark deletes the shuffle files of a finished step when the driver collects the step's plan as garbage, which a
    driver with little to do may not do for half an hour; each cut asks for it before it writes (:func:`settle`).
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    settle(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def settle(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that shuffle files that nothing refers to any more are deleted."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*cuts: DataFrame) -> None:
    """Delete the tables of cuts that no later step reads."""
    for df in cuts:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the fast built-in serves texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of a text (null: none), white space being the six ASCII characters only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def ranked(df: DataFrame, group: list[str], part: str, order: list[str], out: str) -> DataFrame:
    """``out``: 0-based rank of each row in ``group``, by ``part`` and then ``order``.

    ``part`` deals each group into pieces that fit one task; a group is never sorted as a whole.  Only the counts of
    pieces are summed along a group.
    """
    counts = df.groupBy(*group, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, part).orderBy(*order)
    numbered = df.withColumn(out, F.row_number().over(inside).cast("long") - 1)
    return numbered.join(offsets, [*group, part]).withColumn(out, F.col(out) + F.col("__before")).drop("__before")
