"""Operator 2: mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuo.llm.common import WORD, cut, unit, words


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, total: Column | float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to a table of (``weight``, ``size``), one row per source.

    Each round shares what clamped sources leave over by weight among the others and clamps those that would exceed
    ``max_epochs`` times their size, until none does.  Infeasible totals end with every source clamped.  A round is
    one aggregation over the source table; three numbers reach the driver.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    level, clamped = 0.0, F.lit(False)
    seen = -1
    while True:
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)).cast("double").alias("free"),
            F.sum(clamped.cast("long")).alias("n"),
        ).first()
        if not row["free"] or row["n"] == seen:
            break
        seen = row["n"]
        level = (total - row["used"]) / row["free"]
        clamped = cap <= F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns one row per row of ``docs``: doc_id, source, size, source_size, target, taken (all words, repeats counted).
    A source takes each document ``floor(target / source_size)`` whole times; the rest of its target is filled in
    seeded order by one more whole repetition each, and the document on the border gives the words still wanted, so a
    source's sum is its rounded target.

    Null or empty texts have size 0 and take 0; sources of size 0 have target 0; a null source is a source of its own,
    last in order; repeated rows are rows of their own (which of equal rows gives more is not told apart); an empty
    table gives an empty table.  ``weights`` repeat along the sources in code-point order.  The source table (one row
    per source, an aggregate) is the only thing that is ordered as a whole.
    """
    size = word_count(F.col(text_col))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            size.alias("size"),
            unit(F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.col(text_col)))).alias("u"),
        ),
        "mix-sizes",
    )
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = cut(by_source.withColumn("weight", weight), "mix-sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    filled = water_fill(sources, share * total, max_epochs)
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    filled = filled.select(
        F.col("source").alias("__source"),
        F.col("size").alias("source_size"),
        "target",
        F.floor(ratio).alias("whole"),
        F.ceil(F.sqrt("n")).alias("buckets"),
    ).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    # The order within a source is by hash bucket, then hash: about sqrt(n) buckets of sqrt(n) rows, so neither the
    # sums along the buckets nor a bucket's own running sum grows with the source.
    spread = rows.join(filled, rows["source"].eqNullSafe(filled["__source"])).drop("__source")
    spread = spread.withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
    key = ["source", "bucket"]
    sums = spread.groupBy(*key).agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("__source"),
        F.col("bucket").alias("__bucket"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*key).orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    spread = spread.join(
        sums, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket"))
    )
    left = F.col("rest") - F.col("__before") - F.col("__inside")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return spread.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
    )


def resample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every whole repetition, and the border document of a
    source once more with its first words, joined by one space.

    Rows the mix takes nothing of (among them all without words) are left out.  Rows that agree in id, source and size
    are told apart by number, so repeated rows are mixed one by one.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).select("doc_id", "source", "size", "taken")
    key = ["__id", "__source", "__size"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("__taken"))
    taken = taken.toDF(*key, "__taken").withColumn("__nth", nth)
    rows = docs.withColumns(
        {"__i": F.col(id_col), "__s": F.col(source_col), "__n": word_count(F.col(text_col))}
    ).withColumn("__k", F.row_number().over(Window.partitionBy("__i", "__s", "__n").orderBy(text_col)))
    same = (
        F.col("__i").eqNullSafe(F.col("__id"))
        & F.col("__s").eqNullSafe(F.col("__source"))
        & (F.col("__n") == F.col("__size"))
        & (F.col("__k") == F.col("__nth"))
    )
    rows = rows.join(taken.filter("__taken > 0"), same)
    rest = F.col("__taken") % F.col("__size")
    times = F.floor(F.col("__taken") / F.col("__size")) + F.when(rest > 0, 1).otherwise(0)
    rows = rows.withColumn("__time", F.explode(F.sequence(F.lit(1), times)))
    partial = (rest > 0) & (F.col("__time") == times)
    head = F.array_join(F.slice(words(F.col(text_col)), F.lit(1), rest.cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(partial, head).otherwise(F.col(text_col)))
    return rows.select(*docs.columns)
