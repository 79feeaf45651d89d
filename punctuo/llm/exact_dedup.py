"""Operator 6: exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuo.llm.common import ascii_lower, cut

#: Survivor keys up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def normal(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    text = normal(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).alias("len"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("head"),
        text.alias("text"),
    )


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """The rows whose text, after lower-casing A-Z, equals another row's: doc_id, len, head, full_hash.

    Groups by length, then by the hash of the first ``prefix`` characters; only rows of groups that survive both are
    hashed in full (SHA-256).  Null counts as the empty text; repeated rows are equal rows; an empty table gives none.
    """
    slim = cut(_keyed(docs, id_col, text_col, prefix).select("doc_id", "len", "head"), "dedup-keys")
    lengths = slim.groupBy("len").count().filter("count > 1").select("len")
    heads = slim.join(lengths, "len", "left_semi").groupBy("len", "head").count().filter("count > 1")
    heads = cut(heads.select("len", "head"), "dedup-heads")
    keys = F.broadcast(heads) if heads.count() <= BROADCAST_KEYS else heads
    survivors = _keyed(docs, id_col, text_col, prefix).join(keys, ["len", "head"], "left_semi")
    return cut(survivors.select("doc_id", "len", "head", F.sha2("text", 256).alias("full_hash")), "dedup-full")


def groups(refined: DataFrame) -> DataFrame:
    """Per text that occurs more than once: full_hash, keep_id (largest doc_id), group_size.  Sums before it shuffles."""
    found = refined.groupBy("full_hash").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.filter("group_size > 1")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """``docs`` without the rows whose equal with a larger doc_id stays.  All columns stay as they are.

    A null doc_id counts as smaller than any; rows that repeat text and doc_id all stay (they are one document).
    """
    refined = refine(docs, id_col, text_col, prefix)
    losers = refined.join(groups(refined), "full_hash").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    losers = losers.select(F.struct("doc_id", "len", "head", "full_hash").alias("__k")).distinct()
    text = normal(text_col)
    key = F.struct(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).alias("len"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("head"),
        F.sha2(text, 256).alias("full_hash"),
    )
    return docs.withColumn("__k", key).join(losers, "__k", "left_anti").drop("__k")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    found = groups(refine(docs, id_col, text_col, prefix))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normal(text_col), 256).alias("text_sha256"))
    joined = rows.join(found, rows["text_sha256"] == found["full_hash"], "left")
    keep = F.when(F.col("full_hash").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
