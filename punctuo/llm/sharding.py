"""Operator 9: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

DataFrame functions only; the driver draws the matrix from the partitions' counts.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.llm.common import cut, ranked, unit


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good`` + ``bad`` are good: inversion outward from the mode, any population size."""
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((good + 1) * (draws + 1) // (good + bad + 2), low), high)
    logs = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(logs(good, mode) + logs(bad, draws - mode) - logs(good + bad, draws))
    u = rng.random() - peak
    down = up = peak
    i = j = mode
    while u > 0 and (i > low or j < high):
        if j < high:
            up *= (good - j) * (draws - j) / ((j + 1) * (bad - draws + j + 1))
            j += 1
            u -= up
            if u <= 0:
                return j
        if i > low:
            down *= i * (bad - draws + i) / ((good - i + 1) * (draws - i + 1))
            i -= 1
            u -= down
            if u <= 0:
                return i
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows: how many rows each partition sends to each shard; columns sum to shard sizes at most one apart."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng, matrix = random.Random(seed), []
    for n in counts:
        row, open_room = [], sum(room)
        for s in range(shards):
            open_room -= room[s]
            take = hypergeometric(rng, room[s], open_room, n) if n and room[s] else 0
            row.append(take)
            n -= take
        room = [r - t for r, t in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 40,
    seed: int = 29,
    parts: int = 4096,
    rows_per_task: int = 50_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes + 16), text_crc32, shard, slot.

    Shard sizes differ by one row at most and every order is equally likely.  Input partitions (folded to at most
    ``parts``) draw their counts to shards from the exact joint law, permute their rows by a seeded hash, send
    consecutive runs to shards, and each shard permutes again by a second hash.  A shard is ranked in hash buckets of
    about ``rows_per_task`` rows.  Null and empty texts have size 16 and CRC 0; repeated rows are rows of their own;
    an empty table gives an empty table.  Reruns over the same partitions agree.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.spark_partition_id() % parts).alias("part"),
    )
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "part"))
    rows = cut(rows, "shard-rows")
    counted = sorted(tuple(r) for r in rows.groupBy("part").count().collect())
    matrix = communication_matrix([n for _, n in counted], shards, seed)
    sent = [(part, list(accumulate(row))) for (part, _), row in zip(counted, matrix, strict=True)]
    ends = F.broadcast(spark.createDataFrame(sent, "part int, ends array<long>"))  # at most `parts` rows
    # The permutation inside a partition: hash buckets keep a large partition from one sort.
    per_part = max(1, -(-max([n for _, n in counted], default=1) // rows_per_task))
    rows = rows.withColumn("bucket", F.floor(unit(F.col("order")) * per_part))
    dealt = ranked(rows, ["part"], "bucket", ["order", "doc_id", "size"], "rank").join(ends, "part")
    at = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int")
    dealt = dealt.select("doc_id", "size", "text_crc32", at.alias("shard"), F.xxhash64(F.lit(~seed), "order").alias("order"))
    per_shard = max(1, -(-sum(n for _, n in counted) // (shards * rows_per_task)))
    dealt = dealt.withColumn("bucket", F.floor(unit(F.col("order")) * per_shard))
    return ranked(dealt, ["shard"], "bucket", ["order", "doc_id", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )
