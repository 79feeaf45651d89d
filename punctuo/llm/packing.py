"""Operator 7: packing token sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.llm.common import cut, ranked

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SLOTS = "length long, lo long, hi long, per long, first_sequence long, first_offset long"


#: A white-space character that separates parts, rare in texts.
END = "\r"
#: Fixed value: the letter that stands for a space in a byte-level vocabulary; other printable ASCII stands for itself.
SPACE = "\u0120"
#: The pieces of a part of printable ASCII without apostrophes: runs of letters, of digits, of other characters.
RUN = re.compile(r" ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+")
#: A space that belongs to the word after it.
TAKEN = re.compile(r" (?=\S)")


class Runs(dict):
    """The ids of single pieces by the tokeniser's own model, which is spared the search for pieces."""

    def __init__(self, tokenizer, remember: int):
        super().__init__()
        self.model, self.remember = tokenizer.model, remember

    def __missing__(self, run: str) -> bytes:
        if len(self) > self.remember:
            self.clear()
        self[run] = ids = array("I", [t.id for t in self.model.tokenize(run.replace(" ", SPACE))]).tobytes()
        return ids


class ChunkEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, remembering the ids of text between single spaces.

    A byte-level pre-tokeniser without a normaliser or prefix space always starts a new piece at a space that is followed
    by a character other than white space, so a text cut there can be encoded part by part.  Parts not met before are
    encoded many at a time, a line each: a line end between two parts is a piece, and a token, of its own.  Parts of plain
    ASCII are cut into their runs, which recur more than whole parts, and go to the tokeniser's model.  Texts with
    added tokens, and all texts of other tokenisers, are encoded whole.
    """

    def __init__(self, path: str, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.remember = Tokenizer.from_file(path), {}, remember
        spec = json.loads(Path(path).read_text())
        cut_by = spec.get("pre_tokenizer") or {}
        plain = cut_by.get("type") == "ByteLevel" and not cut_by.get("add_prefix_space") and cut_by.get("use_regex", True)
        line = self._whole([END])[0]
        self.line = array("I", line)[0] if plain and not spec.get("normalizer") and len(line) == 4 else None
        self.runs = Runs(self.tokenizer, remember)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that hold no END, nor white space at either end but for a leading space."""
        ids = np.array(self.tokenizer.encode_batch_fast([END.join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.line).tolist()
        return [ids[lo + 1 : hi].tobytes() for lo, hi in zip([-1, *ends], [*ends, len(ids)], strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        first, rest = {}, []
        for i, text in enumerate(texts):
            if self.line is None or any(t in text for t in self.added):
                first[i] = text
                rest.append(())
            else:
                first[i], *more = TAKEN.split(text)
                rest.append(more)
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known  # ids of " " + part, by part
        missing = set().union(*rest) - known.keys()
        lines = []
        for c in missing:
            if self.line is not None and c.isascii() and c.isprintable() and " " not in c and "'" not in c:
                known[c] = b"".join(map(self.runs.__getitem__, RUN.findall(" " + c)))
            elif c.strip() == c and END not in c:
                lines.append(c)
        for at in range(0, len(lines), 1000):
            some = lines[at : at + 1000]
            known.update(zip(some, self._lines([" " + c for c in some]), strict=True))
        alone = [c for c in missing if c not in known]
        known.update(zip(alone, self._whole([" " + c for c in alone]), strict=True))
        starts = self._whole(list(first.values()))
        out = [b"".join([start, *map(known.__getitem__, more)]) for start, more in zip(starts, rest, strict=True)]
        for c in missing:
            if len(c) > 200:
                del known[c]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """A worker's encoder; tasks of one worker share what it remembers."""
    return ChunkEncoder(path)


def tokenise(
    docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, lot: int = 200
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, its ids followed by ``end_id``; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, lot):
                ids, texts = (batch.column(i).slice(at, lot).to_pylist() for i in (0, 1))
                rows = []
                for doc, got in zip(ids, encode([t or "" for t in texts]), strict=True):
                    got += end
                    n = len(got) // 4
                    for start in range(0, n, capacity):
                        piece = got[4 * start : 4 * (start + capacity)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, PIECES
    )


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, as rows of ``SLOTS``.

    Lengths are placed longest first.  A length goes to the pattern with the most room (the shortest pack), splitting a
    pattern's count where fewer pieces are left than packs; where none has room, new packs hold as many as fit.  Works
    on counts alone: its cost and the number of rows depend on the number of lengths, which ``capacity`` bounds.
    """
    by_room: dict[int, list[tuple[int, tuple]]] = {}

    def put(count: int, runs: tuple, room: int) -> None:
        if count:
            by_room.setdefault(room, []).append((count, runs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=-1)
            if room < length:
                per = capacity // length
                put(left // per, ((length, per),), capacity - per * length)
                if left % per:
                    put(1, ((length, left % per),), capacity - left % per * length)
                break
            count, runs = by_room[room].pop()
            per = max(1, min(room // length, left // count))
            used = min(count, left // per)
            put(count - used, runs, room)
            put(used, (*runs, (length, per)), room - per * length)
            left -= used * per
    slots, sequence = [], 0
    placed = dict.fromkeys(histogram, 0)
    for room in sorted(by_room):
        for count, runs in by_room[room]:
            offset = 0
            for length, per in runs:
                lo = placed[length]
                placed[length] = hi = lo + count * per
                slots.append((length, lo, hi, per, sequence, offset))
                offset += length * per
            sequence += count
    return slots


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids (with ``end_id``) are cut every ``capacity`` ids; the pieces' lengths are counted, packed as
    counts (:func:`plan`), and pieces take their places by their rank among those of the same length.  Null and empty
    texts are the end id alone; a repeated row is packed again; an empty table gives no rows.  Only the histogram (at
    most ``capacity`` rows) reaches the driver, and only the packing patterns' slots, bounded by it, are broadcast.
    """
    pieces = cut(
        tokenise(docs, id_col, text_col, tokenizer, capacity, end_id).withColumn("part", F.spark_partition_id()),
        "pack-pieces",
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = docs.sparkSession.createDataFrame(plan(histogram, capacity), SLOTS).withColumnRenamed("length", "__length")
    placed = ranked(pieces, ["length"], "part", ["doc_id", "start", "ids_crc32"], "rank")
    at = (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    return placed.join(F.broadcast(slots), at).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )
