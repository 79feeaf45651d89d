"""Operator 11: WARC archives with revisit records, and their index by an external merge of sorted capture runs."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctuo.llm.common import cut, shared_dir

BREAK = "\r\n"
#: Names of record ids are tag URIs: one for each page id.
RECORD = "tag:punctuo.example,2024:page/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads that hold a share of the repeated rows of one in so many are joined by broadcast: there are no more than these.
HOT = 1000
ENTRY = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.int64()), ("place", pa.int64()),
])
SQL_TYPES = (
    "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, file string, offset long, length long, run long, place long"
)


def base32_sha1(text: Column) -> Column:
    """SHA-1 in base 32: the 40 hexadecimal digits by fives, each of which is four digits of base 32."""
    hexed = F.sha1(text)
    fours = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(rows: DataFrame, key: list[str], least_bytes: int) -> DataFrame:
    """``rows`` (page_id, payload_bytes, body, key...) with ``refers_to``, the smallest page_id with the same payload, where
    that is another row's; such rows lose their body.

    Payloads are counted before the shuffle.  Those that hold a thousandth of all repeated rows or more are at most a
    thousand and are broadcast, so that no join has a key with more rows than that share.
    """
    many = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy(*key).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    many = cut(many.filter("n > 1"), "warc-repeated")
    total = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = many.filter(F.col("n") * HOT >= total).select(*key, F.col("first").alias("hot_first"))
    cold = many.filter(F.col("n") * HOT < total).select(*key, F.col("first").alias("cold_first"))
    other = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col("page_id"))
    out = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    out = out.withColumn("body", F.when(other("hot_first"), "").otherwise(F.col("body")))
    # Rows of hot payloads take part in the second join under keys of their own, which fit nothing.
    lone = F.when(F.col("is_hot"), F.concat(F.lit("#"), F.hash("page_id", "url").cast("string"))).otherwise(F.col(key[0]))
    out = out.withColumn("lone", lone).join(cold.withColumnRenamed(key[0], "lone"), ["lone", *key[1:]], "left")
    refers = F.when(other("hot_first"), F.col("hot_first")).when(other("cold_first"), F.col("cold_first"))
    return out.withColumn("refers_to", refers).withColumn("body", F.when(other("cold_first"), "").otherwise(F.col("body")))


def write(
    pages: DataFrame,
    path: str,
    captured: Column,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    least_bytes: int = 0,
    records_per_file: int = 1000,
) -> None:
    """Write every row of ``pages`` as a WARC/1.1 record to files of at most ``records_per_file`` records under ``path``.

    The row with the smallest id of those with one payload of ``least_bytes`` or more is a ``response``, as are shorter
    ones; the others are ``revisit`` records without the payload, whose HTTP header keeps its length.  Spark's text writer
    ends each record with the two line breaks that WARC asks for, and commits files as it does any others.  Null payloads
    are empty; null urls have no target; characters of urls that would end a header are percent-encoded.  Rows with a null
    id refer to the smallest id of their payload, where there is none they are responses; rows that repeat the id of a
    response are responses as well.  Equal payloads are those of equal SHA-1, length and 64-bit hash.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), captured.cast("timestamp").alias("captured"), body.alias("body"),
        base32_sha1(body).alias("sha1"), F.xxhash64(body).alias("hash64"), F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    rows = revisits(rows, ["sha1", "hash64", "payload_bytes"], least_bytes)
    again = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "\t", "%09")
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"),
        F.lit(BREAK * 2),
    )
    header = F.concat_ws(
        BREAK, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Date: "), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}{BREAK}WARC-Refers-To: "), name("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length("body")).cast("string")),
    )
    record = F.concat(header, F.lit(BREAK * 2), http, F.col("body")).alias("value")
    rows.select(record).write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str | None) -> str:
    """Key by which captures are sorted: the host's labels from the last to the first (no ``www.``), ``)``, and the rest of
    the url up to ``#``.  What is no url is its own key; null is empty."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return url or ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[end:].partition("#")[0] or "/")


def _named(headers: dict[bytes, bytes], name: bytes) -> int | None:
    value = headers.get(name, b"").decode().removeprefix(f"<{RECORD}").removesuffix(">")
    return int(value) if value not in ("", "none") else None


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = (line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def records(content: bytes) -> Iterator[tuple]:
    """The records of an archive: (captured, page_id, url, payload bytes, digest, type, refers_to, offset, length)."""
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        headers = _fields(content[at:head_end])
        start = head_end + 4
        end = start + int(headers[b"content-length"])
        http_end = content.index(b"\r\n\r\n", start, end) + 4
        digest, kind = headers[b"warc-payload-digest"].decode().removeprefix("sha1:"), headers[b"warc-type"].decode()
        size = int(_fields(content[start:http_end])[b"content-length"])
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(memoryview(content)[http_end:end]).digest()).decode()
            if found != digest or size != end - http_end:
                raise ValueError(f"the record at {at} does not hold the payload that its header names")
        url = headers[b"warc-target-uri"].decode(errors="replace") if b"warc-target-uri" in headers else None
        refers = _named(headers, b"warc-refers-to")
        yield headers.get(b"warc-date", b"").decode(), _named(headers, b"warc-record-id"), url, size, digest, kind, refers, at, end - at
        at = end + 4


def order(e: tuple) -> tuple:
    """By url key, time and page id (null last); ties by file and offset."""
    return e[0], e[1], e[2] is None, e[2] or 0, e[8], e[9]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Capture runs of the archives under ``path``: each task indexes its files and sorts what it found (``run``, ``place``).

    Payloads of responses are hashed again; an archive whose payload is not the one its header names ends the job.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, found = TaskContext.get().partitionId(), []
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for when, page, url, *rest, offset, length in records(content.as_py()):
                    found.append((url_key(url), when, page, url, *rest, file, offset, length))
        found.sort(key=order)
        rows = [(*e, run, i) for i, e in enumerate(found)]
        for i in range(0, len(rows), 10_000):
            columns = zip(*rows[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ENTRY, strict=True)], schema=ENTRY)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(index, SQL_TYPES)


def merged_order(keys: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, index) of the sorted lists' items in order, by a loser tree: each item is compared once a level.

    ``losers[1:]`` are the inner nodes of a tree whose leaves are the runs; each keeps the run that lost there, and
    ``losers[0]`` the run that won all.  A run at its end loses to all; equal keys go to the smaller run.
    """
    k = len(keys)
    at = [0] * k

    def before(a: int, b: int) -> bool:
        if at[a] == len(keys[a]) or at[b] == len(keys[b]):
            return at[b] == len(keys[b]) and (at[a] < len(keys[a]) or a < b)
        x, y = keys[a][at[a]], keys[b][at[b]]
        return x < y or (x == y and a < b)

    winners, losers = [0] * k + list(range(k)), [0] * max(k, 1)
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if before(a, b) else (b, a)
    winner = winners[1] if k > 1 else 0
    while k and at[winner] < len(keys[winner]):
        yield winner, at[winner]
        at[winner] += 1
        node = (winner + k) // 2
        while node:
            if before(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def merge(sorted_runs: DataFrame, per_task: int = 100_000) -> DataFrame:
    """All captures in order of url key and time, with ``position`` (gapless from 0).

    The keys are cut into ranges of about ``per_task`` captures; a task takes the slices of all runs in its range and
    merges them by a loser tree.  Keys are url, time, id, file and offset, so that a page with very many captures spans
    ranges.
    """
    count = sorted_runs.count()

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=ENTRY)
        part, cols = TaskContext.get().partitionId(), [table.column(i).to_pylist() for i in range(12)]
        slices: dict[int, list[int]] = {}
        for i, run in enumerate(cols[11]):
            slices.setdefault(run, []).append(i)
        rows = list(zip(*cols, strict=True))
        held = list(slices.values())
        taken = [held[r][i] for r, i in merged_order([[order(rows[i]) for i in s] for s in held])]
        out = table.take(pa.array(taken, pa.int64()))
        out = out.set_column(11, "run", pa.array([part] * len(taken), pa.int64())).set_column(12, "place", pa.array(range(len(taken)), pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    by = ["url_key", "captured", F.asc_nulls_last("page_id"), "file", "offset"]
    ranges = sorted_runs.repartitionByRange(max(1, -(-count // per_task)), *by).sortWithinPartitions("run", "place")
    merged = cut(ranges.mapInArrow(merging, SQL_TYPES), "warc-merged")
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = merged.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return merged.join(starts, "run").withColumn("position", F.col("start") + F.col("place")).drop("run", "place", "start")


def histories(merged: DataFrame) -> DataFrame:
    """Per url key its captures, the first and last time, and the positions it spans."""
    return merged.groupBy("url_key").agg(
        F.count(F.lit(1)).alias("captures"), F.min("captured").alias("first"), F.max("captured").alias("last"),
        F.min("position").alias("from"), F.max("position").alias("to"),
    )


def archive(pages: DataFrame, captured: Column, per_task: int = 100_000, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder (:func:`write`), read them back and merge their index (:func:`merge`)."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, captured, **options)
    return merge(cut(runs(spark, path), "warc-runs"), per_task)
