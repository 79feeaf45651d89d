"""Word sequences as 64-bit hashes, whole Arrow batches at a time in numpy, for use inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Words longer than this many bytes are hashed from there on by xxh3.
_LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half the bits of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a batch of texts in one run: their hashes, where they are in ``data``, and how many each text has."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    data: np.ndarray

    @property
    def edges(self) -> np.ndarray:
        """Where each text's words begin and end among all words."""
        return np.concatenate([[0], np.cumsum(self.sizes)])


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Cut a string column at the six ASCII white-space characters; null texts have no words.

    ``lower`` lower-cases A-Z first.  Hashes are 64 bits of all bytes of a word.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if not len(texts) or texts.buffers()[2] is None:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(texts), np.int64), np.zeros(0, np.uint8))
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.zeros(last - first + 8, np.uint8)  # padded, as eight bytes are read at a time
    data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    if lower:
        data = _LOWER[data]
    offsets = offsets - first
    if texts.null_count:  # bytes under a null are no text
        for i in np.flatnonzero(~np.asarray(texts.is_valid())).tolist():
            data[offsets[i] : offsets[i + 1]] = 32
    solid = np.zeros(len(data) - 7, bool)
    solid[:-1] = ~_SPACE[data[:-8]]
    before = np.zeros_like(solid)
    before[1:] = solid[:-1]
    before[offsets] = False  # a text does not go on with the word of the one before
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros_like(solid)
    after[:-1] = solid[1:] & before[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    length = ends - starts
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    hashes = mixed(length.astype(np.uint64) + _STEP)
    which, at, left = np.arange(len(starts)), starts, length
    done = 0
    while len(which) and done < _LONG:
        chunk = view[at] & _MASK[np.minimum(left, 8)]
        hashes[which] = mixed(hashes[which] * _STEP ^ chunk)
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
        done += 8
    for k, a, n in zip(which.tolist(), at.tolist(), left.tolist(), strict=True):
        hashes[k] ^= np.uint64(xxhash.xxh3_64_intdigest(data[a : a + n].tobytes()))
    sizes = np.diff(np.searchsorted(starts, offsets))
    return Words(hashes, starts, ends, sizes, data)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every ``n`` consecutive words."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    for j in range(1, n):
        out = out * _STEP + hashes[j : j + size]
    return mixed(out)


def whole(sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all runs of ``n`` words of a batch, which lie within one text, and the text of each of those."""
    owner = np.repeat(np.arange(len(sizes)), sizes)[: max(0, int(sizes.sum()) - n + 1)]
    inside = np.arange(len(owner)) + n <= np.cumsum(sizes)[owner]
    return inside, owner[inside]


def shingle_sets(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of ``n`` words of each text, sorted: all sets in one array, and the size of each.

    A text with fewer words is one shingle, one without words is the empty set.
    """
    inside, own = whole(sizes, n)
    out = grams(hashes, n)[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        end = np.cumsum(sizes)
        alone = [grams(hashes[end[i] - sizes[i] : end[i]], sizes[i])[0] ^ np.uint64(sizes[i]) for i in short.tolist()]
        at = np.searchsorted(own, short)
        out, own = np.insert(out, at, np.array(alone, np.uint64)), np.insert(own, at, short)
    edges = np.searchsorted(own, np.arange(len(sizes) + 1)).tolist()
    for lo, hi in zip(edges, edges[1:]):
        out[lo:hi].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    return out[fresh], np.bincount(own[fresh], minlength=len(sizes))


def set_hashes(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.zeros(len(sizes), np.uint64)
    np.add.at(sums, np.repeat(np.arange(len(sizes)), sizes), mixed(shingles ^ _STEP))
    return mixed(sums + sizes.astype(np.uint64) * _STEP).view(np.int64)
