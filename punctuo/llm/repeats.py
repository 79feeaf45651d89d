"""Operator 3: removing passages that an earlier document has, by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.llm.common import cut, forget
from punctuo.llm.shingles import Words, grams, whole, words_of

#: Pieces that one automaton serves, about.
PIECES_PER_SHARD = 20_000
#: Anchors whose places would fill half a shard are confirmed and located by single windows; see :func:`_hot_starts`.
HOT_PLACES = PIECES_PER_SHARD // 2
#: Recurring windows of such anchors up to this number (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Words that one dictionary of letters holds at most; there are 1,112,063 code points.
LETTERS = 1_000_000
#: Windows in a piece at most.
LONGEST = 16
LAST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def pieces(hashes: np.ndarray, sizes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Pieces of the texts of a batch: text, anchor, first window (counted in its text) and number of windows of each.

    The anchor of a window is the smallest hash of its ``anchor``-word sequences, so equal windows have equal anchors.  A
    piece is a run of windows of one text with one anchor, LONGEST at most; each window is in one piece.
    """
    inside, own = whole(sizes, window)
    low, width, all_of = grams(hashes, anchor), 1, window - anchor + 1
    while 2 * width <= all_of:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < all_of and len(low):
        low = np.minimum(low[: len(low) - (all_of - width)], low[all_of - width :])
    low = low[: len(inside)][inside]
    at = np.flatnonzero(inside) - (np.cumsum(sizes) - sizes)[own]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (own[1:] != own[:-1])
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(low)), 0))
    fresh |= (np.arange(len(low)) - run) % LONGEST == 0
    first = np.flatnonzero(fresh)
    return own[first], low[first], at[first], np.diff(first, append=len(low))


def joined(words: Words) -> tuple[bytes, np.ndarray]:
    """The texts of a batch with their words joined by one space, one after the other, and where each begins and ends."""
    n, edges = len(words.data), words.edges
    keep = np.zeros(n, np.int8)
    keep[words.starts] += 1
    keep[words.ends] -= 1
    keep = np.cumsum(keep, dtype=np.int8).astype(bool)
    last = np.zeros(len(words.starts), bool)
    last[edges[1:][words.sizes > 0] - 1] = True
    gap = words.ends[~last]
    keep[gap] = True
    data = words.data.copy()
    data[gap] = 32
    length = np.zeros(len(words.starts) + 1, np.int64)
    length[1:] = np.cumsum(words.ends - words.starts + ~last)
    return data[keep].tobytes(), length[edges]


def _lots(batches: Iterator[pa.RecordBatch], lot: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, lot):
            yield batch.slice(at, lot)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """A list for each of ``n`` owners, which ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _digests(words: Words) -> tuple[list[bytes], bytes, list[int]]:
    text, ends = joined(words)
    view, ends = memoryview(text), ends.tolist()
    return [hashlib.sha256(view[lo:hi]).digest() for lo, hi in zip(ends, ends[1:])], text, ends


def _keys(digests: list[bytes]) -> np.ndarray:
    """The key of a text: 64 bits of its digest."""
    return np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], np.int64)


def _anchored(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches, 500):
            words = words_of(b.column(1))
            digests = _digests(words)[0]
            own, found, _, _ = pieces(words.hashes, words.sizes, window, anchor)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(words.sizes), pa.array([d.hex() for d in digests]), pa.array(_keys(digests)),
                    _lists(found.view(np.int64), own, b.num_rows),
                ],
                names=["doc_id", "n_words", "digest", "text", "anchors"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, digest string, text long, anchors array<long>")


def _held(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per text of ``chosen``: text, doc, packed (its joined words, zstd) and what ``chosen`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in _lots(batches, 500):
            digests, text, ends = _digests(words_of(b.column(1)))
            packed = [squeeze.compress(text[lo:hi]) for lo, hi in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(_keys(digests)), pa.array(packed, pa.binary())], names=["doc_id", "text", "packed"]
            )

    texts = docs.mapInArrow(run, "doc_id long, text long, packed binary")
    same = texts.join(chosen, "text").filter(F.coalesce("doc_id", F.lit(LAST)) == F.col("doc"))
    return same.drop("doc_id").dropDuplicates(["text"])


def _expanded(packed: list[bytes]) -> tuple[pa.Array, Words]:
    expand = zstandard.ZstdDecompressor()
    texts = pa.array([expand.decompress(p) for p in packed], pa.binary()).view(pa.string())
    return texts, words_of(texts)


def _picked(b: pa.RecordBatch, column: str, window: int, anchor: int) -> tuple[Words, tuple[np.ndarray, ...]]:
    """The words of a batch of held texts, and of their pieces those that ``column`` numbers: text, anchor, first, count."""
    _, words = _expanded(b.column("packed").to_pylist())
    own, low, first, count = pieces(words.hashes, words.sizes, window, anchor)
    begin = np.searchsorted(own, np.arange(b.num_rows))
    lists = b.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    pick = np.sort(np.repeat(begin, sizes) + lists.flatten().to_numpy())
    return words, tuple(x[pick] for x in (own, low, first, count))


def _cuts(held: DataFrame, window: int, anchor: int) -> DataFrame:
    """The usual pieces of the held texts: anchor, text, doc, first, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches, 200):
            words, (own, low, first, count) = _picked(b, "usual", window, anchor)
            at = words.edges[own] + first
            data = words.data.tobytes()
            spans = zip(words.starts[at].tolist(), words.ends[at + count + window - 2].tolist(), strict=True)
            cuts = [data[lo:hi] for lo, hi in spans]
            text, doc = (b.column(c).to_numpy()[own] for c in ("text", "doc"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(low.view(np.int64)), pa.array(text), pa.array(doc), pa.array(first.astype(np.int32)),
                    pa.array(cuts, pa.binary()).view(pa.string()),
                ],
                names=["anchor", "text", "doc", "first", "words"],
            )

    rows = held.filter(F.size("usual") > 0).select("text", "doc", "packed", "usual")
    return rows.mapInArrow(run, "anchor long, text long, doc long, first int, words string")


def _windows(held: DataFrame, window: int, anchor: int) -> DataFrame:
    """The single windows of the other pieces: anchor, mark (a hash of the words), text, doc, starts (in that text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches, 200):
            words, (own, low, first, count) = _picked(b, "common", window, anchor)
            at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            own, low = np.repeat(own, count), np.repeat(low, count)
            mark = grams(words.hashes, window)[words.edges[own] + at] if len(at) else np.zeros(0, np.uint64)
            order = np.lexsort((at, mark, own))
            own, low, mark, at = own[order], low[order], mark[order], at[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (mark[1:] != mark[:-1])
            edges = np.append(np.flatnonzero(fresh), len(at)).astype(np.int32)
            text, doc = (b.column(c).to_numpy()[own[fresh]] for c in ("text", "doc"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(low[fresh].view(np.int64)), pa.array(mark[fresh].view(np.int64)), pa.array(text), pa.array(doc),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(at.astype(np.int32))),
                ],
                names=["anchor", "mark", "text", "doc", "starts"],
            )

    rows = held.filter(F.size("common") > 0).select("text", "doc", "packed", "common")
    return rows.mapInArrow(run, "anchor long, mark long, text long, doc long, starts array<int>")


def locate(shard: pd.DataFrame, window: int) -> pd.DataFrame:
    """Confirm the passages that several documents of the shard have, compile them, and stream its pieces past them.

    ``shard``: anchor, text, doc, first, words.  Returns text and starts (a list): the windows that an earlier document has.

    Windows that occur in two documents or more are confirmed; neighbouring ones of a piece are one passage.  Passages are
    compiled with the first document of each of their windows, as strings of one code point a word, from a dictionary of
    the shard.  A shard with more words than there are letters is done in two parts, as windows of different anchors differ.
    """
    import ahocorasick

    nth, texts = pd.factorize(shard["words"])
    words = words_of(pa.array(texts, pa.string()))
    if len(words.hashes) > LETTERS and shard["anchor"].nunique() > 1:
        anchors = np.sort(shard["anchor"].to_numpy())
        middle = max(anchors[len(anchors) // 2], anchors[anchors > anchors[0]][0])
        parts = (shard[shard["anchor"] < middle], shard[shard["anchor"] >= middle])
        return pd.concat([locate(part, window) for part in parts])
    letter = np.unique(words.hashes, return_inverse=True)[1].astype(np.uint32) + 1
    letter += np.where(letter >= 0xD800, np.uint32(0x800), np.uint32(0))  # no surrogates
    spelt, edges = letter.astype("<u4").tobytes().decode("utf-32-le"), words.edges.tolist()

    docs = shard["doc"].to_numpy()
    lo, hi = np.full(len(texts), LAST), np.full(len(texts), -LAST)
    np.minimum.at(lo, nth, docs)
    np.maximum.at(hi, nth, docs)
    inside, own = whole(words.sizes, window)
    mark = grams(words.hashes, window)[inside]
    _, same = np.unique(mark, return_inverse=True)
    first, last = np.full(len(mark), LAST), np.full(len(mark), -LAST)
    np.minimum.at(first, same, lo[own])
    np.maximum.at(last, same, hi[own])
    first, again = first[same], (first < last)[same]
    place = np.flatnonzero(inside)
    begins = again.copy()
    begins[1:] &= ~(again[:-1] & (own[1:] == own[:-1]))
    ends = again.copy()
    ends[:-1] &= ~(again[1:] & (own[1:] == own[:-1]))
    passages: dict[str, int] = {}
    for x, y in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist(), strict=True):
        passages.setdefault(spelt[place[x] : place[y] + window], x)
    automaton = ahocorasick.Automaton()
    for passage, x in passages.items():
        automaton.add_word(passage, (x, len(passage) - window + 1))
    where, which, found = [], [], []
    if passages:
        automaton.make_automaton()
        for i, (at, end) in enumerate(zip(edges, edges[1:])):
            for stop, (x, count) in automaton.iter(spelt[at:end]):
                where.append(stop - count - window + 2)
                which.append(i)
                found.append((x, count))
    x, count = np.array(found, np.int64).reshape(-1, 2).T
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hits = pd.DataFrame(
        {
            "nth": np.repeat(np.array(which, np.int64), count), "offset": np.repeat(np.array(where, np.int64), count) + step,
            "earliest": first[np.repeat(x, count) + step],
        }
    ).drop_duplicates(["nth", "offset"])
    rows = pd.DataFrame({"nth": nth, "text": shard["text"].to_numpy(), "doc": docs, "first": shard["first"].to_numpy()})
    on = rows.merge(hits, on="nth")
    on = on[on["earliest"] < on["doc"]]
    starts = (on["first"] + on["offset"]).groupby(on["text"]).agg(list)
    return pd.DataFrame({"text": starts.index, "starts": starts.to_numpy()})


def _hot_starts(held: DataFrame, window: int, anchor: int) -> DataFrame:
    """What :func:`locate` finds, for anchors with too many places for a shard: text, starts.

    Each single window is a key of its own (its anchor and a hash of its words), so equal windows meet while an anchor
    spreads over all tasks.  Their first and last documents are summed up before they are shuffled, and the recurring
    ones, a row each, are joined to their texts: by broadcast if they are few, else by a shuffle that deals skew anew.
    """
    windows = _windows(held, window, anchor)
    again = windows.groupBy("anchor", "mark").agg(F.min("doc").alias("earliest"), F.max("doc").alias("last"))
    again = cut(again.filter("earliest < last").select("anchor", "mark", "earliest"), "repeats-windows")
    few = F.broadcast(again) if again.count() <= BROADCAST_WINDOWS else again
    return windows.join(few, ["anchor", "mark"]).filter("earliest < doc").select("text", "starts")


def _without(rows: DataFrame, window: int) -> DataFrame:
    """Cut the windows that start at ``starts`` out of ``packed``: text, n_removed, kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in _lots(batches, 100):
            removed, digests, kept = [], [], []
            for packed, starts in zip(b.column("packed").to_pylist(), b.column("starts"), strict=True):
                words = expand.decompress(packed).split(b" ")
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(starts.values.to_numpy())
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                text = b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])
                removed.append(len(words) - int(stay.sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("text"), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept)],
                names=["text", "n_removed", "kept_sha256", "kept"],
            )

    return rows.select("text", "packed", "starts").mapInArrow(
        run, "text long, n_removed long, kept_sha256 string, kept string"
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, anchor: int = 5
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (null where nothing is removed).

    1. Every document's windows of ``window`` words are cut into pieces by anchor (:func:`pieces`).  Documents of the same
       words are one text: only the first of them is looked at, and the others lose all their words if a window fits.
       Anchors that only one text has are dropped.
    2. The pieces of the others are cut from the texts and dealt to shards by anchor, so all places of a window meet in one
       shard.  Each shard confirms its recurring windows, compiles them, merged into passages, into an automaton and
       streams its pieces past it (:func:`locate`).  Anchors with more than HOT_PLACES places, which no shard could hold,
       are confirmed and located by single windows (:func:`_hot_starts`).
    3. Windows that a smaller doc_id has are cut out of the texts.

    Null and empty texts have no words.  A null doc_id counts as larger than any.  Rows with the same doc_id are one
    document in judging (none is smaller) and stay rows of their own.  Texts of any length are one row.  An empty table
    gives an empty table.  Words, windows and texts are compared by 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = cut(_anchored(docs, window, anchor), "repeats-anchors")
    places = made.select("text", F.posexplode("anchors").alias("at", "anchor"))
    counts = places.groupBy("anchor").agg(F.min("text").alias("x"), F.max("text").alias("y"), F.count(F.lit(1)).alias("n"))
    counts = counts.filter("x <> y").select("anchor", (F.col("n") > HOT_PLACES).alias("hot"))
    again = places.join(counts, "anchor").groupBy("text").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("at"))).alias("usual"), F.collect_set(F.when(F.col("hot"), F.col("at"))).alias("common")
    )
    firsts = made.groupBy("text").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc"))
    chosen = cut(again.join(firsts, "text"), "repeats-places")
    light = cut(made.drop("anchors"), "repeats-light")
    forget(made)
    held = cut(_held(docs, chosen), "repeats-held")
    number = chosen.agg(F.sum(F.size("usual"))).first()[0] or 0
    forget(chosen)
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-number // PIECES_PER_SHARD))))
    starts = _cuts(held, window, anchor).withColumn("shard", shard).groupBy("shard").applyInPandas(
        lambda pdf: locate(pdf, window), "text long, starts array<int>"
    )
    starts = starts.unionByName(_hot_starts(held, window, anchor))
    starts = starts.groupBy("text").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    removed = cut(_without(held.select("text", "packed").join(starts, "text"), window), "repeats-removed")
    forget(held)
    firsts = light.groupBy("text").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc"))
    on = light.join(firsts, "text").join(removed, "text", "left")
    later = (F.coalesce("doc_id", F.lit(LAST)) > F.col("doc")) & (F.col("n_words") >= window)
    return on.select(
        "doc_id",
        "n_words",
        F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(later, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(later, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
