"""Operator 5: exact n-gram Jaccard self-join by universe partition and pigeonhole."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from punctuo.llm.common import cut, forget
from punctuo.llm.components import components
from punctuo.llm.shingles import mixed, set_hashes, shingle_sets, words_of

#: Posting lists estimated to be long: signatures met at least HOT_SETS times, and of these the HOT_KEPT most frequent
#: (8 bytes each go to every task).  They steer which signatures a set is indexed under; links do not depend on them.
HOT_SETS, HOT_KEPT = 24, 200_000
NONE, ONE = np.zeros(0, np.uint64), np.uint64(1)
#: Up to this many (set, document) ids are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: A signature with up to SMALL sets is compared pair by pair at once; one with more in blocks of about BLOCK.
SMALL, BLOCK = 8, 256
#: Rounds of chains at most, each of four pairs a set; what they leave is compared in full.
CHAINED = 3
#: Sets of one ``main`` are compared in full at once if that sends each of them no more often than this: about what a round
#: of chains sends.
AT_ONCE = 8
#: Buckets of the sketches that are asked first.
COARSE = 64


def size_bands(size: int, percent: int, step: float) -> list[tuple[int, int]]:
    """(number, largest size) of the bands of a set: band j holds sizes over step^j and up to step^(j+1) * 100 / percent.

    Neighbouring bands overlap by 100 / percent, so two sets that can be linked share a band.
    """
    low = math.floor(math.log(size, step)) + 1
    found = []
    for j in range(low, -3, -1):
        top = math.floor(step ** (j + 1) * 100 / percent + 1e-9)
        if top < size:
            break
        if step**j < size:
            found.append((j, top))
    return found


def differing(a: int, b: int, percent: int) -> int:
    """Linked sets of these sizes differ by at most so many shingles."""
    return (100 - percent) * (a + b) // (100 + percent)


class Index:
    """Signatures of sets; two linked sets share at least one.

    **Subsets.**  In each of its size bands the universe is dealt into m segments by hash, m being well above the number H
    of shingles by which linked sets of the band can differ, so they agree on m - H segments at least.  A set ranks its
    non-empty segments by estimated cost: a posting list known to be long last, then more shingles first, then by hash.
    Cost is a function of the subset alone, so of the segments that two linked sets agree on, the cheapest is among the
    H + 1 cheapest of both, and only these are indexed.  A set with no more than H non-empty segments also has the band's
    common mark, for pairs that agree on empty segments alone.

    **One-deletion neighbourhoods.**  If a set's H + 1 cheapest segments include long posting lists, those subsets are not
    indexed.  The set gets a second allocation: m = floor(H / 2) + 1 larger segments of a narrow band, each indexed as a
    whole and with every single shingle deleted.  Of two linked sets, at least one of these segments differs by one shingle
    or none, so the whole segment of one meets the whole or a one-deletion neighbour of the other.  If the cheapest segment that two sets agree on is a long posting list, both have left it out, so both have
    the second allocation; if not, both have it in the first.

    The lowest bit of a signature tells one-deletion neighbours (1), which need not meet one another.
    """

    def __init__(self, percent: int, hot: np.ndarray = NONE):
        self.percent, self.hot = percent, hot
        self.wide: dict[int, list] = {}
        self.narrow: dict[int, list] = {}

    def _bands(self, known: dict[int, list], step: float, sizes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """The sets of each band by their numbers."""
        out: dict[tuple[int, int], list[int]] = {}
        for i, size in enumerate(sizes.tolist()):
            if size:
                if size not in known:
                    known[size] = size_bands(size, self.percent, step)
                for band in known[size]:
                    out.setdefault(band, []).append(i)
        return {band: np.array(members) for band, members in out.items()}

    def _dealt(self, shingles: np.ndarray, start: np.ndarray, sizes: np.ndarray, members: np.ndarray, m: int, salt: int):
        """The shingles of ``members`` one after the other, and the segment of each (counted on from set to set)."""
        own = np.repeat(np.arange(len(members)), sizes[members])
        at = np.repeat(start[members] - (np.cumsum(sizes[members]) - sizes[members]), sizes[members]) + np.arange(len(own))
        x = shingles[at]
        return x, own, own * m + (mixed(x + np.uint64(salt)) % np.uint64(m)).astype(np.int64)

    def subsets(self, shingles: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        """For each band: members, its number, m, H of each member, and of each non-empty segment its set, count and hash."""
        start = np.cumsum(sizes) - sizes
        for (band, top), members in self._bands(self.wide, 3.0, sizes).items():
            m = max(differing(top, top, self.percent) + 2, math.ceil(0.4 * top))
            x, own, key = self._dealt(shingles, start, sizes, members, m, 7 + band)
            count = np.bincount(key, minlength=len(members) * m)
            sums = np.zeros(len(count), np.uint64)
            np.add.at(sums, key, x)
            number = np.flatnonzero(count)
            salt = mixed(np.arange(m, dtype=np.uint64) + (np.uint64(band + 64) << np.uint64(40)))
            found = mixed(sums[number] + salt[number % m]) & ~ONE
            partner = np.minimum(top, sizes[members] * 100 // self.percent)
            most = (100 - self.percent) * (sizes[members] + partner) // (100 + self.percent)
            yield members, band, most, number // m, count[number], found

    def neighbourhoods(self, shingles: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> Iterator[tuple]:
        """For the sets ``asked``, by narrow band: the set of each signature and the signature."""
        start = np.cumsum(sizes) - sizes
        alone = np.where(asked, sizes, 0)
        for (band, top), members in self._bands(self.narrow, 100 / self.percent, alone).items():
            m = differing(top, top, self.percent) // 2 + 1
            x, own, key = self._dealt(shingles, start, sizes, members, m, 131 + band)
            sums = np.zeros(len(members) * m, np.uint64)
            np.add.at(sums, key, x)
            salt = mixed(np.arange(m, dtype=np.uint64) + (np.uint64(band + 1024) << np.uint64(40)))
            yield np.repeat(members, m), mixed(sums + np.tile(salt, len(members))) & ~ONE
            yield members[own], mixed(sums[key] - x + salt[key % m]) | ONE

    def signatures(self, shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of sets that lie in ``shingles`` one after the other: the set of each, and the signature."""
        owner, out, dear = [], [], np.zeros(len(sizes), bool)
        for members, band, most, own, count, found in self.subsets(shingles, sizes):
            # One number for the order: long posting list, then fewer shingles, then hash.
            cost = (found >> np.uint64(16)) | ((0x7FFF - np.minimum(count, 0x7FFF)).astype(np.uint64) << np.uint64(48))
            if len(self.hot):
                common = self.hot[np.searchsorted(self.hot, found) % len(self.hot)] == found
                cost |= common.astype(np.uint64) << np.uint64(63)
            edges = np.searchsorted(own, np.arange(len(members) + 1)).tolist()
            chosen = []
            for lo, hi, h in zip(edges, edges[1:], most.tolist()):
                if hi - lo > h + 1:
                    chosen.append(lo + np.argpartition(cost[lo:hi], h)[: h + 1])
                else:
                    chosen.append(np.arange(lo, hi))
            pick = np.concatenate(chosen)
            long = cost[pick] >> np.uint64(63) != 0
            dear[members[own[pick[long]]]] = True
            owner.append(members[own[pick[~long]]])
            out.append(found[pick[~long]])
            few = np.diff(edges) <= most
            owner.append(members[few])
            out.append(np.repeat(mixed(np.array([band + 64], np.uint64)) & ~ONE, few.sum()))
        for own, found in self.neighbourhoods(shingles, sizes, dear) if dear.any() else ():
            owner.append(own)
            out.append(found)
        return np.concatenate([np.zeros(0, np.int64), *owner]), np.concatenate([NONE, *out])


def _lots(batches: Iterator[pa.RecordBatch], lot: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, lot):
            yield batch.slice(at, lot)


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle sets of a lot of texts: shingles, sizes, and a hash of each set."""
    words = words_of(texts, lower=True)
    shingles, sizes = shingle_sets(words.hashes, words.sizes, n)
    return shingles, sizes, set_hashes(shingles, sizes)


def _some(shingles: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingles[np.repeat(keep, sizes)], np.where(keep, sizes, 0)


def _hot(docs: DataFrame, text_col: str, n: int, percent: int) -> np.ndarray:
    """Long posting lists of subsets, from all documents: what a lot of them has twice is summed over all lots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(percent)
        for b in _lots(batches, 2000):
            shingles, sizes, ids = _sets(b.column(0), n)
            first = np.zeros(len(ids), bool)
            first[np.unique(ids, return_index=True)[1]] = True
            found = [part[-1] for part in index.subsets(*_some(shingles, sizes, first))]
            value, count = np.unique(np.concatenate([NONE, *found]), return_counts=True)
            more = count > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[more].view(np.int64)), pa.array(count[more].astype(np.int64))], names=["s", "n"]
            )

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "s long, n long").groupBy("s")
    top = counted.agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_SETS).orderBy(F.desc("n"), "s").limit(HOT_KEPT)
    return np.sort(top.select("s").toArrow()["s"].to_numpy().astype(np.int64).view(np.uint64))


def sketches(shingles: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Shingles by bucket, up to one a bucket on average; the number of buckets is a power of two, 16 at least."""
    out, mix = [], mixed(shingles + np.uint64(11))
    end = np.cumsum(sizes)
    for lo, hi in zip((end - sizes).tolist(), end.tolist()):
        buckets = 1 << max(4, (hi - lo - 1).bit_length())
        at = (mix[lo:hi] & np.uint64(buckets - 1)).astype(np.int64)
        out.append(np.minimum(np.bincount(at, minlength=buckets), 255).astype(np.uint8).tobytes())
    return out


def folded(sketch: np.ndarray, buckets: int) -> np.ndarray:
    """A sketch (or rows of them) with fewer buckets."""
    return sketch.astype(np.int32).reshape(*sketch.shape[:-1], -1, buckets).sum(axis=-2)


def least_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No sets with these sketches differ by fewer shingles.  ``y`` may hold several sketches of one length as rows.

    Capped counts only make it less: |min(a, c) - min(b, c)| <= |a - b|, also for sums of them.
    """
    few = min(x.shape[-1], y.shape[-1])
    return np.abs(folded(x, few) - folded(y, few)).sum(axis=-1)


def _indexed(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    hot = _hot(docs, text_col, n, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = Index(percent, hot), set()
        for b in _lots(batches, 500):
            shingles, sizes, ids = _sets(b.column(1), n)
            # An equal set of the same task adds no signatures, nor does a row without an id, which links with nothing.
            fresh = np.zeros(len(ids), bool)
            for i, (doc, own) in enumerate(zip(b.column(0).to_pylist(), ids.tolist(), strict=True)):
                if doc is not None and own not in seen:
                    seen.add(own)
                    fresh[i] = True
            if len(seen) > 500_000:
                seen.clear()
            owner, found = index.signatures(*_some(shingles, sizes, fresh))
            order = np.argsort(owner, kind="stable")
            offsets = np.searchsorted(owner[order], np.arange(len(ids) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(sizes.astype(np.int64)), pa.array(ids),
                    pa.array(sketches(shingles, sizes), pa.binary()), lists,
                ],
                names=["doc_id", "n_shingles", "set_id", "sketch", "found"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_id long, sketch binary, found array<long>"
    )


def _with_coarse(known: DataFrame) -> DataFrame:
    """``known`` (set_id, size, rep, sketch) with coarse: the sketch in at most COARSE buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [np.frombuffer(x, np.uint8) for x in b.column("sketch").to_pylist()]
            coarse = [np.minimum(folded(x, min(COARSE, len(x))), 255).astype(np.uint8).tobytes() for x in whole]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(coarse, pa.binary())], names=[*b.schema.names, "coarse"])

    return known.mapInArrow(run, StructType([*known.schema.fields, StructField("coarse", BinaryType())]))


def _promising(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b: set ids) without those whose sizes and sketches rule a link out.

    Coarse sketches are asked first, so that the whole ones, a byte a shingle, travel with fewer pairs.
    """
    return _allowed(_allowed(pairs, known, "coarse", percent), known, "sketch", percent)


def _allowed(pairs: DataFrame, known: DataFrame, sketch: str, percent: int) -> DataFrame:
    left = known.select(F.col("set_id").alias("a"), F.col("size").alias("size_a"), F.col(sketch).alias("sketch_a"))
    right = known.select(F.col("set_id").alias("b"), F.col("size").alias("size_b"), F.col(sketch).alias("sketch_b"))
    fit = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    rows = pairs.join(left, "a").join(right, "b").filter(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = b.column("size_a").to_numpy() + b.column("size_b").to_numpy()
            most = ((100 - percent) * sums // (100 + percent)).tolist()
            both = zip(b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist(), most, strict=True)
            keep = [least_difference(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= m for x, y, m in both]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b: set ids), those whose Jaccard similarity reaches the threshold, counted in whole numbers."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    # A pair travels with one of its sets; the other is sent once for all its pairs.
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches, 200):
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def link(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Equal shingle sets are one set.  Sets meet under the signatures of :class:`Index`.  A signature of few sets gives all
    its pairs; one of more gives some pairs of each set, with the smallest and in random chains, which joins groups of near
    copies without listing their pairs.  Then, for every signature whose sets still lie in several components,
    blocks of its sets are compared across components, after further chains where there are many blocks.  So every link either is found or lies within a component, and
    component ids are exact.  Pairs whose sketches differ too much are dropped before their sets are read; the others are
    verified shingle by shingle.  Shingles and sets are compared by 64-bit hashes.

    Null, empty and blank texts have no shingles and are their own component.  Texts of under ``n`` words are one
    shingle.  Repeated rows and copies share a component.  Rows with a null doc_id link with nothing and have a null
    component_id.  An empty table gives an empty table.
    """
    return _labelled(docs, id_col, text_col, n, percent).drop("set_id")


def _labelled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """The rows of :func:`link` with their set_id."""
    made = cut(_indexed(docs, id_col, text_col, n, percent), "jaccard-sets")
    ids = made.filter("doc_id is not null and n_shingles > 0")
    meets = ids.select(F.explode("found").alias("s"), "set_id").select(
        F.col("s").bitwiseAND(~1).alias("signature"), "set_id", F.col("s").bitwiseAND(1).cast("byte").alias("gone")
    )
    group = Window.partitionBy("signature")  # its rows pass through one sort that spills; they are never held together
    least = F.min(F.when(F.col("gone") == 0, F.col("set_id"))).over(group)
    shared = meets.withColumns({"lo": least, "x": F.min("set_id").over(group), "y": F.max("set_id").over(group)})
    shared = shared.filter("x <> y and lo is not null").groupBy("signature", "set_id").agg(F.min("gone").alias("gone"), F.min("lo").alias("lo"))
    shared = shared.withColumn("sets", F.count(F.lit(1)).over(group))
    shared = cut(shared, "jaccard-shared")
    rows = cut(made.drop("found"), "jaccard-rows")
    forget(made)
    ids = rows.filter("doc_id is not null and n_shingles > 0")
    sets = ids.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    meeting = shared.select("set_id").distinct()
    known = ids.join(meeting, "set_id", "left_semi").groupBy("set_id", F.col("n_shingles").alias("size"))
    known = cut(_with_coarse(known.agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))), "jaccard-known")
    repeated = rows.groupBy("doc_id").count().filter("doc_id is not null and count > 1").limit(1).count() > 0

    def linked(near: DataFrame) -> DataFrame:
        near = cut(near, "jaccard-pairs")
        held = _shingled(docs, id_col, text_col, near, known, n, repeated)
        found = cut(_verified(near, held, percent), "jaccard-links")
        forget(held, near)
        return found

    first = cut(_few(shared).unionByName(_chained(shared)).distinct(), "jaccard-first")
    links = linked(_promising(first, known, percent))
    joined = components(links)

    # Signatures with many sets: where blocks of a main would be many, it is chained as long as that joins some (CHAINED
    # times at most).  What is left is compared across components, by the components that it was last looked up in.
    rest = _open(shared.filter(F.col("sets") > SMALL), joined)
    still = cut(_still_open(rest, joined), "jaccard-still")
    forget(rest)
    tried, used, ready = first, [shared, first, links, still], still.filter(~_dear())
    large = still.filter(_dear())
    if not large.isEmpty():
        own = cut(known.join(large.select("set_id").distinct(), "set_id", "left_semi"), "jaccard-large")
        used.append(own)
        for turn in range(CHAINED):
            near = cut(_chains(large, "main", 4 * turn).join(tried, ["a", "b"], "left_anti").distinct(), "jaccard-tried")
            found = linked(_promising(near, own, percent))
            tried, used = tried.unionByName(near), [*used, near, found]
            if found.isEmpty():
                break
            joined = _wider(joined, found)
            still = cut(_still_open(large, joined), "jaccard-still")
            used, ready, large = [*used, still], ready.unionByName(still.filter(~_dear())), still.filter(_dear())
            if large.isEmpty():
                break
    second = linked(_many(ready.unionByName(large), known, percent).join(tried, ["a", "b"], "left_anti"))
    joined = _wider(joined, second)
    forget(*used, second)
    at = sets.join(joined.toDF("set_id", "component"), "set_id", "left")
    at = at.select("set_id", "rep", F.coalesce("component", "set_id").alias("component"))
    named = at.join(at.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("set_id", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    own = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "set_id")


def _wider(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined`` (node, component) with further ``links`` (a, b), which are few once they are put between components."""
    if links.isEmpty():
        return joined
    name = lambda end: F.coalesce(F.col(f"{end}{end}.component"), F.col(end)).alias(end)
    ends = links.join(joined.alias("aa"), F.col("a") == F.col("aa.node"), "left").select(name("a"), "b")
    ends = ends.join(joined.alias("bb"), F.col("b") == F.col("bb.node"), "left").select("a", name("b"))
    again = components(ends).toDF("part", "wider")
    old = joined.join(again, F.col("component") == F.col("part"), "left").select("node", F.coalesce("wider", "component").alias("component"))
    new = again.join(joined, F.col("part") == F.col("node"), "left_anti").toDF("node", "component")
    return cut(old.unionByName(new), "jaccard-joined")


def _few(shared: DataFrame) -> DataFrame:
    """All pairs of signatures of at most SMALL sets, but of two one-deletion neighbours: a, b."""
    held = shared.filter(F.col("sets") <= SMALL).groupBy("signature")
    held = held.agg(F.sort_array(F.collect_list(F.struct("set_id", "gone"))).alias("s"))
    pair = lambda x, y: F.struct(x["set_id"].alias("a"), y["set_id"].alias("b"), (x["gone"] + y["gone"]).alias("gone"))
    each = F.transform(
        F.sequence(F.lit(1), F.size("s") - 1),
        lambda i: F.transform(F.slice("s", i + 1, F.size("s")), lambda y: pair(F.get("s", i - 1), y)),
    )
    return held.select(F.explode(F.flatten(each)).alias("p")).filter("p.gone < 2").select("p.a", "p.b")


def _chained(shared: DataFrame) -> DataFrame:
    """Some pairs of signatures of more sets: each set with the smallest set it meets, and chains of those that meet it."""
    of = shared.filter(F.col("sets") > SMALL).groupBy("set_id").agg(F.min("lo").alias("lo")).withColumn("component", F.col("set_id"))
    star = of.filter("set_id <> lo").select(F.least("set_id", "lo").alias("a"), F.greatest("set_id", "lo").alias("b"))
    return star.unionByName(_chains(of, "lo"))


def _chains(of: DataFrame, group: str, first: int = 0, chains: int = 4) -> DataFrame:
    """Pairs of each set with its next in several random orders of its group, where that is of another component: a, b.

    An order is cut into buckets of about BLOCK, so that no group is sorted as a whole.  ``sets``, if there, is how many the
    group has.
    """
    if "sets" not in of.columns:
        of = of.join(of.groupBy(group).agg(F.count(F.lit(1)).alias("sets")), group)
    of = of.select(group, "set_id", "component", F.ceil(F.col("sets") / BLOCK).alias("buckets"))
    both = None
    for seed in range(first, first + chains):
        order = F.xxhash64("set_id", F.lit(seed))
        step = Window.partitionBy(group, F.pmod(order, "buckets")).orderBy(order, "set_id")
        some = of.select("set_id", "component", F.lead(F.struct("set_id", "component")).over(step).alias("next"))
        some = some.filter(F.col("component") != F.col("next.component")).select("set_id", F.col("next.set_id").alias("other"))
        both = some if both is None else both.unionByName(some)
    return both.select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b"))


def _open(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """The sets of signatures that lie in several components, by the least component of their signature: main, set_id."""
    labels = joined.withColumnRenamed("node", "set_id")
    at = shared.select("signature", "set_id").join(labels, "set_id", "left")
    at = at.select("signature", "set_id", F.coalesce("component", "set_id").alias("component"))
    several = at.groupBy("signature").agg(F.min("component").alias("main"), F.max("component").alias("last"))
    several = several.filter("main <> last").select("signature", "main")
    return cut(at.join(several, "signature").select("main", "set_id").distinct(), "jaccard-open")


def _dear() -> Column:
    """Whether the blocks of a ``main`` would send its sets more than AT_ONCE times on average."""
    lots = lambda n: F.ceil(F.col(n) / BLOCK)
    return lots("sets") * F.col("others") + lots("others") * F.col("sets") > AT_ONCE * F.col("sets")


def _still_open(rest: DataFrame, joined: DataFrame) -> DataFrame:
    """``rest`` with the components of now; home: the component that ``main`` lies in; sets, others: how many ``main`` has
    in all and outside that component, if any.  What is closed stays so, so each turn starts from what the last one left.

    Homes are looked up once a ``main`` and counted by its components, not once a set.  Sketches stay behind.
    """
    at = rest.select("main", "set_id").join(joined.toDF("set_id", "component"), "set_id", "left")
    at = at.withColumn("component", F.coalesce("component", "set_id"))
    parts = at.groupBy("main", "component").agg(F.count(F.lit(1)).alias("n"))
    homes = parts.select("main").distinct().join(joined.toDF("main", "home"), "main", "left")
    homes = homes.select("main", F.coalesce("home", "main").alias("home"))
    away = F.coalesce(F.sum(F.when(F.col("component") != F.col("home"), F.col("n"))), F.lit(0))
    counts = parts.join(homes, "main").groupBy("main", "home").agg(F.sum("n").alias("sets"), away.alias("others"))
    return at.join(counts.filter("others > 0"), "main")


def near_by_sketch(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``left`` and of ``right`` (size, component, sketch) lie in two components and may be linked."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for buckets, at in right.groupby(right["sketch"].map(len)).indices.items():
        y = np.frombuffer(b"".join(right["sketch"].iloc[at]), np.uint8).reshape(len(at), buckets)
        size, home = right["size"].to_numpy()[at], right["component"].to_numpy()[at]
        kept = {buckets: y.astype(np.int16)}
        for i, (own, part, sketch) in enumerate(zip(left["size"], left["component"], left["sketch"], strict=True)):
            near = np.flatnonzero((home != part) & (100 * np.minimum(size, own) >= percent * np.maximum(size, own)))
            if not len(near):
                continue
            x = np.frombuffer(sketch, np.uint8)
            few = min(buckets, len(x))
            if few not in kept:
                kept[few] = folded(y, few)
            gap = np.abs(kept[few][near] - folded(x, few).astype(kept[few].dtype)).sum(axis=1, dtype=np.int64)
            near = near[gap <= (100 - percent) * (size[near] + own) // (100 + percent)]
            rows.append(np.full(len(near), i))
            cols.append(at[near])
    return np.concatenate(rows), np.concatenate(cols)


def _many(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that sizes and sketches allow, among the sets of one ``main``: a, b.

    The sets outside the main component meet all its sets, in blocks of about BLOCK of either; a task compares sketches
    and gives only the pairs that pass, so neither a whole signature nor all its pairs are ever in one place.
    """
    lot = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n, seed: F.pmod(F.xxhash64("set_id", F.lit(seed)), lot(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), lot(n) - 1))
    row = ["main", "set_id", "component", "home"]
    asking = members.filter("component <> home").select(*row, place("others", 7).alias("i"), every("sets").alias("j"), F.lit(0).alias("side"))
    asked = members.select(*row, every("others").alias("i"), place("sets", 5).alias("j"), F.lit(1).alias("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["side"] == side].reset_index(drop=True) for side in (0, 1))
        x, y = near_by_sketch(left, right, percent)
        inner = (right["component"] == right["home"]).to_numpy()[y]  # two others meet twice
        x, y = left["set_id"].to_numpy()[x], right["set_id"].to_numpy()[y]
        x, y = x[inner | (x < y)], y[inner | (x < y)]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    rows = asking.unionByName(asked).join(known.select("set_id", "size", "sketch"), "set_id")
    return rows.groupBy("main", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _shingled(
    docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, known: DataFrame, n: int, repeated: bool
) -> DataFrame:
    """The sets in ``pairs``: set_id, shingles (sorted, 8 bytes each).

    Few ids are broadcast to the scan; many are joined by shuffle.  Where a doc_id repeats, other texts of it go by their
    set.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = cut(known.select("set_id", "rep").join(ids, "set_id", "left_semi"), "jaccard-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(few, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches, 500):
            shingles, sizes, own = _sets(b.column(1), n)
            end = np.cumsum(sizes)
            keep = np.flatnonzero(own == b.column(0).to_numpy())
            held = [shingles[end[i] - sizes[i] : end[i]].tobytes() for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(held, pa.binary())], names=["set_id", "shingles"])

    held = rows.select("set_id", "text").mapInArrow(run, "set_id long, shingles binary")
    out = cut(held.dropDuplicates(["set_id"]) if repeated else held, "jaccard-shingles")
    forget(wanted)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.  All columns stay.

    Rows with a null doc_id, and null, empty and blank texts, stay; repeated rows stay together or go together.  Where a
    doc_id repeats, rows go by doc_id and shingle set, so another text of the same doc_id stays.  An empty table gives an
    empty table.
    """
    found = _labelled(docs, id_col, text_col, n, percent).filter("component_id is not null and doc_id <> component_id")
    losers = found.select(F.col("doc_id").alias("__loser"), F.col("set_id").alias("__lost")).distinct()
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).count()
    if not ids.filter("id is not null and count > 1").limit(1).count():
        return docs.join(losers.select("__loser"), F.col(id_col) == F.col("__loser"), "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches, 500):
            own = _sets(b.column(b.schema.get_field_index(text_col)), n)[2]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=[*b.schema.names, "__set"])

    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__set", LongType())]))
    same = (F.col(id_col) == F.col("__loser")) & (F.col("__set") == F.col("__lost"))
    return marked.join(losers, same, "left_anti").drop("__set")
