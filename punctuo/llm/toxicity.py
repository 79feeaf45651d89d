"""Operator 10: toxicity by a counterfactually regularised logistic regression on hashed words."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.llm.common import cut, forget

# Groups of identity terms; a swap takes each to the next of its group.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives"),
    ("disabled", "blind", "deaf"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY for i, term in enumerate(group)}
TOKEN = re.compile(r"[^\W\d_]+")
#: Documents whose buckets are counted at a time on the driver, which bounds its memory.
COUNTED = 1000


def features_of(word: str, buckets: int) -> tuple[int, ...]:
    """Buckets of a word: itself and, if it is longer, its first four and five letters."""
    keys = [word, *(f"{word[:n]}~{n}" for n in (4, 5) if len(word) > n)]
    return tuple(zlib.crc32(k.encode()) % buckets for k in keys)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    """``weights`` by bucket (only those that count) and the intercept."""

    buckets: int
    intercept: float
    weights: dict[int, float]

    def scorer(self, remember: int = 500_000):
        """A function from text to score; a word's weight is kept, for at most ``remember`` words."""
        get, known = self.weights.get, {}

        def weight(word: str) -> float:
            if len(known) > remember:
                known.clear()
            known[word] = w = sum(get(f, 0.0) for f in features_of(word, self.buckets))
            return w

        def score(text: str | None) -> float:
            z = self.intercept
            for word in set(TOKEN.findall((text or "").lower())):
                w = known.get(word)
                z += weight(word) if w is None else w
            return 1 / (1 + math.exp(-z)) if z > -500 else 0.0

        return score


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int, max_buckets: int, buckets: int) -> pa.Table:
    """Features of labelled rows that are not held out, in seeded order, and what identity swaps take from and add to them.

    At most ``max_rows`` rows, and of these as many as have ``max_buckets`` buckets in all, so that the driver's memory
    is bounded however many words the texts have.  Buckets are counted where the texts are.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
        .dropna()
        .filter(~held_out("__id"))
        .groupBy("__id")
        .agg(F.max("__toxic").alias("__toxic"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(
        F.col("__id"), F.col("__toxic").alias("toxic"), F.col(text_col).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                b = batch.slice(at, 100)
                plain, minus, plus = [], [], []
                for text in b.column("text").to_pylist():
                    found = {*TOKEN.findall((text or "").lower())}
                    swapped = {SWAP.get(w, w) for w in found}
                    plain.append(bag(found))
                    minus.append(bag(found - swapped))
                    plus.append(bag(swapped - found))
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("__id"), b.column("toxic"), *(pa.array(x, kind) for x in (plain, minus, plus))],
                    names=["id", "toxic", "plain", "minus", "plus"],
                )

    def bag(found: set[str]) -> list[int]:
        return [f for w in found for f in features_of(w, buckets)]

    kinds = "id long, toxic int, plain array<int>, minus array<int>, plus array<int>"
    made = cut(rows.select(F.col("__id").cast("long"), "toxic", "text").mapInArrow(run, kinds), "toxicity-sample")
    sizes = made.groupBy(F.xxhash64("id").alias("at")).agg(F.sum(F.size("plain")).alias("n")).orderBy("at").toPandas()
    fit_in = sizes["at"][sizes["n"].cumsum() <= max_buckets]
    taken = made.filter(F.xxhash64("id") <= int(fit_in.iloc[-1]) if len(fit_in) else F.lit(False))
    got = _telling(taken, buckets).toArrow()
    forget(made)
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    return got.take(pa.array(order))


def _telling(taken: DataFrame, buckets: int) -> DataFrame:
    """``taken`` with only the buckets that :func:`fit` keeps, so that the others never reach the driver.  Rows are counted a
    bucket by Spark; the counts are two numbers a bucket."""
    n, toxic = taken.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    each = taken.select("toxic", F.explode(F.array_distinct("plain")).alias("f")).groupBy("f")
    counts = each.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    keep, f = np.zeros(buckets, bool), counts["f"].to_numpy()
    keep[f] = _tells(counts["n"].to_numpy().astype(float), counts["toxic"].to_numpy().astype(float), toxic / n if n else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [pa.array([[x for x in row if keep[x]] for row in b.column(k).to_pylist()], pa.list_(pa.int32())) for k in ("plain", "minus", "plus")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), *kept], names=b.schema.names)

    return taken.mapInArrow(run, taken.schema)


def _tells(all_n: np.ndarray, toxic_n: np.ndarray, share: float, least: int = 5, least_z: float = 3.0) -> np.ndarray:
    """Which buckets ``least`` rows have whose share among toxic rows differs from that among the others by ``least_z`` standard errors."""
    z = (toxic_n - all_n * share) / np.sqrt(np.maximum(all_n * share * (1 - share), 1e-9))
    return (all_n >= least) & (np.abs(z) >= least_z)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and buckets of a list column."""
    array = lists.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    sizes = np.diff(array.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), array.flatten().to_numpy()


def fit(y: np.ndarray, plain: tuple, minus: tuple, plus: tuple, buckets: int, penalty: float = 1.0, ridge: float = 3e-4, rounds: int = 400, least: int = 5, least_z: float = 3.0) -> Model:
    """Logistic regression on bucket counts with ``penalty`` times the mean squared change of a score under identity swaps.

    The change is that of the document's own score, in log-odds, which no certainty of the score can hide: what the
    scorer gives the words of the document after all its identity terms are swapped, less what it gives the document.

    Buckets count that ``least`` rows have and whose share among toxic rows differs from that among the others by
    ``least_z`` standard errors.  Without rows, or with one class only, the model is a constant.
    """
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1)
    intercept = float(np.log(prior / (1 - prior)))
    rows, cols = plain
    if n == 0 or y.min() == y.max():
        return Model(buckets, intercept, {})
    all_n, toxic_n = np.zeros(buckets), np.zeros(buckets)
    for start in range(0, n, COUNTED):  # ``rows`` ascend, so a block has the whole of its documents
        part = slice(*np.searchsorted(rows, (start, start + COUNTED)))
        seen = np.unique(rows[part].astype(np.int64) * buckets + cols[part])
        all_n += np.bincount(seen % buckets, minlength=buckets)
        toxic_n += np.bincount(seen % buckets, weights=y[seen // buckets], minlength=buckets)
    kept = np.flatnonzero(_tells(all_n, toxic_n, y.mean(), least, least_z))
    place = np.full(buckets, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def narrowed(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = place[cols] if len(cols) else cols
        return rows[at >= 0], at[at >= 0]

    rows, cols = narrowed(rows, cols)
    swap_rows, swap_cols, sign = [], [], []
    for part, s in ((minus, -1.0), (plus, 1.0)):
        r, c = narrowed(*part)
        swap_rows.append(r), swap_cols.append(c), sign.append(np.full(len(r), s))
    swap_rows, swap_cols, sign = map(np.concatenate, (swap_rows, swap_cols, sign))
    swapped = max(1, len(np.unique(swap_rows)))
    w, b = np.zeros(len(kept)), intercept
    first, second, bias_first, bias_second = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam, all rows each time
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, weights=w[cols], minlength=n), -50, 50)))
        error = (p - y) / n
        change = np.bincount(swap_rows, weights=w[swap_cols] * sign, minlength=n)
        grad = np.bincount(cols, weights=error[rows], minlength=len(w)) + ridge * w
        grad += 2 * penalty / swapped * np.bincount(swap_cols, weights=change[swap_rows] * sign, minlength=len(w))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - 0.05 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        g = float(error.sum())
        bias_first, bias_second = 0.9 * bias_first + 0.1 * g, 0.999 * bias_second + 0.001 * g * g
        b -= 0.05 * bias_first / (1 - 0.9**t) / (bias_second / (1 - 0.999**t)) ** 0.5 if bias_second else 0.0
    weights = {int(k): float(v) for k, v in zip(kept, w, strict=True) if abs(v) > 1e-3}
    return Model(buckets, float(b), weights)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 10_000,
    max_buckets: int = 50_000_000,
    buckets: int = 1 << 18,
    penalty: float = 1.0,
) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0: at most ``max_rows``, and ``max_buckets`` buckets of their
    words (4 bytes each, if the fit keeps them all), the documented bounds.

    A label that is null takes no part; of several labels of a doc_id the largest counts; rows of a repeated doc_id are
    all learned from, those of a null one are not.  Without labels the model is a constant.
    """
    got = _sample(docs, labels, id_col, text_col, max_rows, max_buckets, buckets)
    y = got["toxic"].to_numpy().astype(float)
    if not len(y):
        return fit(y, *[(np.zeros(0, int), np.zeros(0, int))] * 3, buckets)
    return fit(y, *(_flat(got[k]) for k in ("plain", "minus", "plus")), buckets, penalty)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``, from 0 to 1.

    Whole texts are read; a word counts once.  Null and empty texts get the intercept's score, repeated rows the same
    score.  The model is shipped with the tasks: at most as many weights as the training sample has buckets.
    """
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for some in texts:
            yield pd.Series([of(t) for t in some], dtype="float64")

    return docs.withColumn(out, F.pandas_udf(scored, "double")(F.col(text_col)))
