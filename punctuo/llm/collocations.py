"""Operator 12: phrase collocations from a weighted de Bruijn graph of the longest grams."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctuo.llm.common import cut, forget
from punctuo.llm.shingles import mixed, words_of

LONGEST = 5
#: Bytes of text that a task cuts into words at a time, which takes some 35 times as much memory; a piece of text that is
#: longer is taken whole.
CHUNK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, every piece break as a line feed, a tab as a space: each byte as one byte.
_PLAIN = bytes(10 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGES = "lang string, gram string, size int, weight long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.Array]]:
    """Texts (lang, text) as pieces of about ``CHUNK`` bytes with the language of each; long texts are cut at piece breaks."""
    langs, texts, held = [], [], 0
    for batch in batches:
        for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = value.as_buffer()
            text = (data.to_pybytes() if data else b"").translate(_PLAIN)
            lo = 0
            while lo < len(text):
                hi = len(text)
                if hi - lo > CHUNK:
                    hi = text.rfind(b"\n", lo, lo + CHUNK) + 1 or text.find(b"\n", lo + CHUNK) + 1 or hi
                langs.append(lang)
                texts.append(text[lo:hi])
                held, lo = held + hi - lo, hi
                if held >= CHUNK:
                    yield langs, pa.array(texts, pa.binary())
                    langs, texts, held = [], [], 0
    if texts:
        yield langs, pa.array(texts, pa.binary())


class _Chunk:
    """The words of a chunk, their grams' hashes, and which words follow each other within a piece."""

    def __init__(self, langs: list[str], texts: pa.Array):
        self.words = words_of(texts)
        self.langs, self.owner = langs, np.repeat(np.arange(len(langs)), self.words.sizes)
        marks = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)
        self.one = mixed(self.words.hashes ^ marks[self.owner])
        piece = np.cumsum(self.words.data[:-8] == 10)[self.words.starts] if len(self.one) else self.owner
        self.follows = (self.owner[1:] == self.owner[:-1]) & (piece[1:] == piece[:-1])
        self.two = mixed(self.one[:-1] * _STEP + self.one[1:])
        self.three = mixed(self.two[:-1] * _STEP + self.one[2:])

    def pairs(self, two: Sieve) -> np.ndarray:
        """Whether each word and the next lie in one piece and pass the sieve."""
        return self.follows & two.fits(self.two)

    def triples(self, two: Sieve) -> np.ndarray:
        """The words that with the next two are in one piece, both of whose pairs pass the sieve."""
        on = self.pairs(two)
        return np.flatnonzero(on[:-1] & on[1:])

    def texts(self, at: np.ndarray, size: int) -> list[bytes]:
        """The ``size`` words from each of ``at`` on, joined by one space."""
        w, buf = self.words, self.words.data.tobytes()
        lo, hi = w.starts[at], w.ends[at + size - 1]
        letters = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
        even = (letters[at + size] - letters[at] + size - 1 == hi - lo).tolist()
        return [buf[a:b] if e else b" ".join(buf[a:b].split()) for a, b, e in zip(lo.tolist(), hi.tolist(), even, strict=True)]


class Sieve:
    """One bit for each of 2**bits slots: whether the grams of ``size`` words that fall in it occur ``least`` times in all.

    What does occur so often always has its bit; others may.
    """

    def __init__(self, bits: int, packed: bytes):
        self.bits, self.packed = bits, np.frombuffer(packed, np.uint8)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def fits(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots(hashes)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _counted(slots: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Each slot once with the sum of its counts, which stops at ``least``."""
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, np.int64)
    return slots[first], np.minimum(np.add.reduceat(counts, first) if len(first) else counts, least)


def sieve(texts: DataFrame, least: int, bits: int, before: Sieve | None = None) -> Sieve:
    """The sieve of pairs of words, or, of what passes ``before``, of three words.

    A task tells its slots and their counts in blocks of 65,536; counts are added block by block, one batch at a time.
    Only the bits (8 MB for 26) reach the driver and the tasks, whatever the texts.
    """
    low = min(bits, 16)
    held = Sieve(bits, b"")
    shared = texts.sparkSession.sparkContext.broadcast(before)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for langs, some in _chunks(batches):
            c = _Chunk(langs, some)
            grams = c.two[c.follows] if before is None else c.three[c.triples(shared.value)]
            more.append(np.unique(held.slots(grams), return_counts=True))
            if sum(len(m[0]) for m in more) > 1_000_000:
                slots, counts = _counted(*(np.concatenate(x) for x in zip((slots, counts), *more, strict=True)), least)
                more = []
        slots, counts = _counted(*(np.concatenate(x) for x in zip((slots, counts), *more, strict=True)), least)
        block = slots >> low
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(slots) else np.zeros(1, np.int64)
        inside, number = (slots & ((1 << low) - 1)).astype("<u2"), counts.astype("<u4")
        spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        arrays = [
            pa.array([int(block[i]) for i, _ in spans], pa.int32()), pa.array([inside[i:j].tobytes() for i, j in spans], pa.binary()),
            pa.array([number[i:j].tobytes() for i, j in spans], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["block", "slots", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, slots, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                now = total.setdefault(block, np.zeros(1 << low, np.uint32))
                at = np.frombuffer(slots.as_buffer(), "<u2")
                now[at] = np.minimum(now[at] + np.frombuffer(counts.as_buffer(), "<u4"), least)
        bits_of = [np.packbits(t >= least).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits_of, pa.binary())], ["block", "bits"])

    rows = texts.mapInArrow(count, "block int, slots binary, counts binary").repartition("block").mapInArrow(add, "block int, bits binary")
    found = {r["block"]: bytes(r["bits"]) for r in rows.collect()}
    none = bytes((1 << low) // 8)
    return Sieve(bits, b"".join(found.get(b, none) for b in range(1 << (bits - low))))


def edges(texts: DataFrame, least: int, bits: int = 26) -> DataFrame:
    """The longest gram that starts at each word: (lang, gram, size, weight), summed over all texts (lang, text).

    A gram of :data:`LONGEST` words is an edge of the graph, from the node of its first words to that of its last; a shorter
    one is what is left at the end of a piece.  Two or three words that the sieves rule out end a piece as well, as no
    phrase that occurs ``least`` times holds them.  ``size`` 0 holds the number of all words of a language.  Grams are told
    apart within a task by 64-bit hashes, over all texts by their words.
    """
    pairs = sieve(texts, least, bits)
    shared = texts.sparkSession.sparkContext.broadcast((pairs, sieve(texts, least, bits, pairs)))

    def rows(lang: list[str], gram: list[bytes], size: array, weight: array) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(gram), 20_000):
            part = slice(i, i + 20_000)
            raw = pa.array(gram[part], pa.binary())
            text = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())
            arrays = [pa.array(lang[part], pa.string()), text, pa.array(size[part], pa.int32()), pa.array(weight[part], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "size", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, three = shared.value
        fresh_table = lambda: ({}, ([], [], array("b"), array("q")))  # noqa: E731  where a gram's row is, and the rows by column
        found, table = fresh_table()
        for langs, some in _chunks(batches):
            c = _Chunk(langs, some)
            n = len(c.one)
            if not n:
                continue
            words = _per_lang(c)
            yield from rows(list(words), [b""] * len(words), array("b", bytes(len(words))), array("q", words.values()))
            pair, triple = np.zeros(n, bool), np.zeros(n, bool)
            pair[: n - 1] = c.pairs(two)
            inside = c.triples(two)
            triple[inside] = three.fits(c.three[inside])
            length = np.where(pair, 2, 1)
            for _ in range(LONGEST - 2):
                length[: n - 1] = np.where(triple[: n - 1], 1 + length[1:], length[: n - 1])
            length = np.minimum(length, LONGEST)
            gram = np.zeros(n, np.uint64)
            for size in range(1, LONGEST + 1):
                gram[: n - size + 1] = mixed(gram[: n - size + 1] * _STEP + c.one[size - 1 :] + np.uint64(size))
                at = np.flatnonzero(length == size)
                keys, first, counts = np.unique(gram[at], return_index=True, return_counts=True)
                keys = keys.tolist()
                fresh = np.array([k not in found for k in keys], bool)
                at = at[first[fresh]]
                for key, count, new in zip(keys, counts.tolist(), fresh.tolist(), strict=True):
                    if new:
                        found[key] = len(found)
                        table[3].append(count)
                    else:
                        table[3][found[key]] += count
                table[0].extend(c.langs[i] for i in c.owner[at].tolist())
                table[1].extend(c.texts(at, size))
                table[2].extend([size] * len(at))
            if len(found) > 500_000:
                yield from rows(*table)
                found, table = fresh_table()
        yield from rows(*table)

    return texts.mapInArrow(run, _EDGES).groupBy("lang", "gram", "size").agg(F.sum("weight").alias("weight"))


def _per_lang(c: _Chunk) -> dict[str, int]:
    out: dict[str, int] = {}
    for lang, size in zip(c.langs, c.words.sizes.tolist(), strict=True):
        out[lang] = out.get(lang, 0) + size
    return out


def _first(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def _last(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", -n)


def nodes(found: DataFrame) -> DataFrame:
    """Nodes (lang, gram) with ``weight``, all their occurrences: what flows out plus the pieces that end there; and
    ``unary``: one edge goes in, one out, no piece starts or ends there."""
    long = found.filter(F.col("size") == LONGEST)
    none = F.lit(0).cast("long")
    out = long.select("lang", _first(F.col("gram"), LONGEST - 1).alias("gram"), F.col("weight").alias("out_w"), F.lit(1).alias("out_n"), none.alias("in_w"), F.lit(0).alias("in_n"), none.alias("end_w"))
    into = long.select("lang", _last(F.col("gram"), LONGEST - 1).alias("gram"), none.alias("out_w"), F.lit(0).alias("out_n"), F.col("weight").alias("in_w"), F.lit(1).alias("in_n"), none.alias("end_w"))
    ends = found.filter(F.col("size") == LONGEST - 1)
    ends = ends.select("lang", "gram", none.alias("out_w"), F.lit(0).alias("out_n"), none.alias("in_w"), F.lit(0).alias("in_n"), F.col("weight").alias("end_w"))
    sums = [F.sum(c).alias(c) for c in ("out_w", "out_n", "in_w", "in_n", "end_w")]
    flow = out.unionByName(into).unionByName(ends).groupBy("lang", "gram").agg(*sums)
    unary = (F.col("out_n") == 1) & (F.col("in_n") == 1) & (F.col("end_w") == 0) & (F.col("in_w") == F.col("out_w"))
    return flow.select("lang", "gram", (F.col("out_w") + F.col("end_w")).alias("weight"), unary.alias("unary"))


def paths(found: DataFrame, node_table: DataFrame, least: int) -> DataFrame:
    """Edges of ``least`` occurrences or more, those of a unary path as one: (lang, words, edges, weight).

    Every edge points to the one before it over a unary node; pointers are doubled until all reach the head of their path,
    in as many rounds as the longest path has bits.  Such a path is no circle, as text would have to start in it.
    """
    long = found.filter((F.col("size") == LONGEST) & (F.col("weight") >= least)).select("lang", "gram", "weight")
    via = node_table.filter("unary").select("lang", F.col("gram").alias("via"))
    into = long.select("lang", F.col("gram").alias("before"), _last(F.col("gram"), LONGEST - 1).alias("via")).join(via, ["lang", "via"])
    here = long.withColumn("via", _first(F.col("gram"), LONGEST - 1)).join(into, ["lang", "via"], "left")
    # head: the farthest edge known on the path; steps: how far; more: whether that one has another before it
    chain = here.select("lang", "gram", "weight", F.coalesce("before", "gram").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    chain = cut(chain, "collocations-paths")
    while True:
        up = chain.select("lang", F.col("gram").alias("head"), F.col("head").alias("next"), F.col("steps").alias("far")).filter("far > 0")
        joined = chain.join(up, ["lang", "head"], "left")
        if joined.filter("next is not null").isEmpty():
            break
        far = F.col("steps") + F.coalesce("far", F.lit(0))
        moved = joined.select("lang", "gram", "weight", F.coalesce("next", "head").alias("head"), far.alias("steps"))
        before, chain = chain, cut(moved, "collocations-paths")
        forget(before)
    tail = F.transform(F.array_sort(F.collect_list(F.when(F.col("steps") > 0, F.struct("steps", _last(F.col("gram"), 1).alias("w"))))), lambda x: x["w"])
    whole = chain.groupBy("lang", "head").agg(tail.alias("tail"), F.count(F.lit(1)).alias("edges"), F.first("weight").alias("weight"))
    return whole.select("lang", F.concat(F.split("head", " "), F.col("tail")).alias("words"), "edges", "weight")


def counts(texts: DataFrame, least: int = 100, bits: int = 26) -> DataFrame:
    """Phrases of 1 to 5 words of ``texts`` (lang, text) that occur ``least`` times: (lang, phrase, size, weight); and
    ``size`` 0, the number of all words of each language.

    Counts of the longest come from the compacted paths, those of nodes from their flow, and shorter ones from the flow of
    the next longer plus the pieces that end before it.
    """
    found = cut(edges(texts, least, bits), "collocations-edges")
    node_table = cut(nodes(found), "collocations-nodes")
    long = paths(found, node_table, least)
    windows = F.transform(F.sequence(F.lit(1), F.col("edges").cast("int")), lambda i: F.array_join(F.slice("words", i, LONGEST), " "))
    levels = [found.filter("size = 0").select("lang", F.col("gram").alias("phrase"), "size", "weight")]
    levels += [long.select("lang", F.explode(windows).alias("phrase"), F.lit(LONGEST).alias("size"), "weight")]
    flow = node_table.select("lang", "gram", "weight")
    for size in range(LONGEST - 1, 0, -1):
        if size < LONGEST - 1:
            ends = found.filter(F.col("size") == size).select("lang", "gram", "weight")
            longer = flow.select("lang", _first(F.col("gram"), size).alias("gram"), "weight")
            flow = cut(longer.unionByName(ends).groupBy("lang", "gram").agg(F.sum("weight").alias("weight")), "collocations-flow")
        levels.append(flow.filter(F.col("weight") >= least).select("lang", F.col("gram").alias("phrase"), F.lit(size).alias("size"), "weight"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def scored(table: DataFrame) -> DataFrame:
    """Candidates (2 to 5 words) of a table of :func:`counts` with their lowest-scoring cut: lang, phrase, size, a, l, r, n,
    score.  Those that a longer candidate holds every time are left out.

    A candidate that lies in a longer one which occurs as often lies in one of one word more that does, as counts only
    fall with length.  Products are taken in 38 digits.
    """
    single = table.filter("size > 0").select("lang", "phrase", "weight")
    every = table.filter("size = 0").select("lang", F.col("weight").alias("n"))  # a row a language
    wide = table.filter("size > 1").select("lang", "phrase", "size", F.col("weight").alias("a"))
    inner = wide.filter("size > 2").select("lang", F.expr("explode(array(substring_index(phrase, ' ', size - 1), substring_index(phrase, ' ', 1 - size)))").alias("phrase"), "a")
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = wide.join(held, ["lang", "phrase"], "left").filter("held is null or held < a").drop("held")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("left"), F.col("weight").alias("l")), ["lang", "left"])
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("right"), F.col("weight").alias("r")), ["lang", "right"])
    cuts = cuts.join(every, "lang")
    score = F.expr("CAST((1000 * CAST(a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(16, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0))) AS LONG)")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("c"))
    return least.select("lang", "phrase", "a", "c.l", "c.r", "c.n", "c.score")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, top: int = 2000, bits: int = 26) -> DataFrame:
    """The ``top`` collocations of each language (a report): lang, rank (from 1), phrase, a, l, r, n, score.

    Null texts are empty, null languages ``und``; a language without candidates has no rows; repeated rows count again.
    A language is ranked in 64 parts first, so that no task orders all its candidates.
    """
    texts = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    found = scored(cut(counts(texts, least, bits), "collocations-counts"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = found.withColumn("part", part).withColumn("r1", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("r1") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return few.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
