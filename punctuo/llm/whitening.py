"""Operator 13: embedding whitening by incremental eigendecomposition, combined over partitions and refined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.llm.common import cut, forget

SCALE, SHIFT = 64, 1_000_000
#: Relative size under which an entry of an update, or a gap between eigenvalues, counts as none.
TINY = 4 * np.finfo(np.float64).eps
#: Eigenvalues under this share of the trace are no components.
RANK = 1e-12
FAN_IN = 16
_SPECTRUM = "part long, n long, mean array<double>, values array<double>, vectors array<double>"


def _deflated(d: np.ndarray, z: np.ndarray, q: np.ndarray, rho: float) -> np.ndarray:
    """Turn ``z`` (and the columns of ``q``) so that of equal eigenvalues one has an entry; which entries are left.

    An entry too small to move an eigenvalue counts as 0; for two eigenvalues whose gap is too small a plane rotation
    moves both entries into the second.
    """
    norm = float(z @ z)
    tol = TINY * max(abs(d[0]), abs(d[-1]), rho * norm)
    live = rho * np.abs(z) * np.sqrt(norm) > tol
    at = np.flatnonzero(live)
    if len(at) > 1 and (np.diff(d[at]) <= tol).any():
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if d[b] - d[a] <= tol and live[a]:
                r = np.hypot(z[a], z[b])
                c, s = z[b] / r, z[a] / r
                z[a], z[b] = 0.0, r
                q[:, a], q[:, b] = c * q[:, a] - s * q[:, b], s * q[:, a] + c * q[:, b]
                live[a] = False
    z[~live] = 0.0
    return live


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z_i^2 / (d_i - x) for rising ``d`` and positive ``rho``, one past each d.

    Given as (roots, gaps): ``gaps[i, j]`` is d_i - x_j, exact also where a root is close to a pole: each root is sought as its
    distance from the nearer pole, by two-pole interpolation inside a bracket that halves where that would leave it.
    """
    k = len(d)
    z2 = rho * z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    width = upper - d
    middle = d + width / 2
    f = 1 + (z2[:, None] / (d[:, None] - middle[None, :])).sum(0)
    left = f >= 0  # the root lies in the left half
    left[-1] = True
    origin = np.where(left, d, upper)
    gap = d[:, None] - origin[None, :]  # d_i less the origin of root j
    lo, hi = np.where(left, 0.0, -width / 2), np.where(left, width / 2, 0.0)
    hi[-1] = width[-1]
    x = (lo + hi) / 2
    below = np.triu(np.ones((k, k)))
    above = 1 - below
    p, r = gap.diagonal(), np.append(gap[np.arange(1, k), np.arange(k - 1)], np.inf)
    for _ in range(60):
        diff = gap - x[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            term = z2[:, None] / diff
            slope = term / diff
        psi, phi = np.einsum("ij,ij->j", term, below), np.einsum("ij,ij->j", term, above)
        dpsi, dphi = np.einsum("ij,ij->j", slope, below), np.einsum("ij,ij->j", slope, above)
        f = 1 + psi + phi
        size = 1 + np.abs(psi) + np.abs(phi)
        done = (np.abs(f) <= 8 * k * np.finfo(np.float64).eps * size) | (hi - lo <= 4 * np.finfo(np.float64).eps * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        lo, hi = np.where(f < 0, x, lo), np.where(f >= 0, x, hi)
        # psi as a + b / (p - x), phi as c + e / (r - x), both with the value and slope that they have here
        dp, dr = p - x, np.where(np.isinf(r), 1.0, r - x)
        b, e = dpsi * dp * dp, np.where(np.isinf(r), 0.0, dphi * dr * dr)
        c0 = f - dpsi * dp - np.where(np.isinf(r), 0.0, dphi * dr)
        # c0 + b / (dp - t) + e / (dr - t) = 0
        qa, qb, qc = c0, -(c0 * (dp + dr) + b + e), c0 * dp * dr + b * dr + e * dp
        root = np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(qb <= 0, 2 * qc / (-qb + root), (-qb - root) / (2 * qa))
            alone = dp + b / c0  # the last root has no pole above it
        t = np.where(np.isinf(r), alone, t)
        new = x + t
        x = np.where(done, x, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return origin + x, gap - x[None, :]


def update(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors (columns) of q diag(d) q' + rho v v', for rho >= 0.

    The new vectors come from the update that has exactly the roots found, so that they are orthogonal to the last digits
    however close the roots are.
    """
    z = q.T @ v
    if not rho > 0 or not np.any(z):
        return d, q
    q = q.copy()
    live = _deflated(d, z, q, rho)
    at = np.flatnonzero(live)
    if not len(at):
        return d, q
    dl = d[at]
    roots, gaps = secular(dl, z[at], rho)
    k = len(at)
    if k > 1:  # Loewner: z_i^2 = prod_j (x_j - d_i) / prod_{j != i} (d_j - d_i)
        ratio = -gaps.copy()
        below = dl[None, :] - dl[:, None]
        np.fill_diagonal(below, 1.0)
        z2 = np.prod(ratio / below, axis=1)
        zn = np.sign(z[at]) * np.sqrt(np.abs(z2))
    else:
        zn = z[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = zn[:, None] / gaps
    bad = ~np.isfinite(u).all(0)
    if bad.any():  # the root is its pole: the vector stays
        u[:, bad] = np.eye(k)[:, bad]
    u /= np.linalg.norm(u, axis=0)
    d, q = d.copy(), q
    q[:, at] = q[:, at] @ u
    d[at] = roots
    by = np.argsort(d, kind="stable")
    return d[by], q[:, by]


class Spectrum:
    """Rows seen so far: their number, mean, and the eigenvalues and vectors of the sum of squares about the mean."""

    def __init__(self, size: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray) -> None:
        step = x - self.mean
        if self.n:
            self.values, self.vectors = update(self.values, self.vectors, step, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + step / self.n

    def join(self, other: Spectrum) -> None:
        """The other's spectrum as a row of rank-one updates, one an eigenvector, and one for the distance of the means."""
        if not other.n:
            return
        step, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.values, self.vectors = update(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = update(self.values, self.vectors, step, self.n * other.n / n)
        self.mean, self.n = self.mean + step * (other.n / n), n

    def row(self, part: int) -> pa.RecordBatch:
        values = [part, self.n, self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist()]
        names = ["part", "n", "mean", "values", "vectors"]
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    @staticmethod
    def of(row: dict) -> Spectrum:
        out = Spectrum(len(row["mean"]))
        out.n, out.mean, out.values = row["n"], np.array(row["mean"]), np.array(row["values"])
        out.vectors = np.array(row["vectors"]).reshape(len(out.mean), -1)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are all of one length, as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x): entries as floor(64 c) + 1000000, of rows without null or non-finite entries; and their length.

    Where lengths differ, the one that most rows have counts (the larger of two) and other rows take no part, nor do those
    with an entry of 2^40 or more, whose sums would pass 64 bits.
    """
    v = F.transform(F.col(vector_col), lambda c: F.floor(SCALE * c.cast("double")) + SHIFT)
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(1 << 40)))
    held = rows.filter(F.col(vector_col).isNotNull() & fine & (F.size(vector_col) > 0)).select(F.col(id_col).alias("vec_id"), v.alias("x"))
    sizes = held.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    size = most["size"] if most else 0
    return held.filter(F.size("x") == size), size


def spectra(fit: DataFrame, size: int) -> Spectrum:
    """The spectrum of ``fit`` (x): every partition takes its rows in one at a time, and partitions are combined by
    :data:`FAN_IN` a round until one is left."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spectrum(size)
        for batch in batches:
            for x in _matrix(batch.column(0)) - SHIFT:
                seen.add(x.astype(np.float64))
        if seen.n:
            yield seen.row(TaskContext.get().partitionId())

    def combine(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = Spectrum.of(parts[0])
        for other in parts[1:]:
            total.join(Spectrum.of(other))
        return pa.Table.from_batches([total.row(parts[0]["part"] // FAN_IN)])

    found = cut(fit.mapInArrow(learn, _SPECTRUM), "whitening-spectra")
    while (count := found.count()) > 1:
        last = count <= FAN_IN
        group = F.lit(0).cast("long") if last else F.floor(F.col("part") / FAN_IN).cast("long")
        merged = found.withColumn("group", group).groupBy("group").applyInArrow(lambda t: combine(t.drop_columns(["group"])), _SPECTRUM)
        before, found = found, cut(merged, "whitening-spectra")
        forget(before)
    row = found.first()
    forget(found)
    return Spectrum.of(row.asDict()) if row else Spectrum(size)


def _moments(fit: DataFrame, center: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the coordinates of ``fit`` about ``center`` in ``basis`` (columns)."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (_matrix(batch.column(0)) - SHIFT - center) @ basis
            total += y.sum(0)
            products += y.T @ y
        rows = pa.array([products[i].tolist() for i in range(k)] + [total.tolist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), rows], ["i", "row"])

    rows = fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((k + 1, k))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # the square of the dimension
        out[r["i"], r["j"]] = r["v"]
    return out[k], out[:k]


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = _matrix(batch.column(0))
            n += len(x)
            total = [a + b for a, b in zip(total, (x.sum(0) if len(x) else np.zeros(size, np.int64)).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))], ["n", "s"])

    rows = fit.mapInArrow(run, "n long, s array<long>")
    n = rows.agg(F.sum("n")).first()[0] or 0
    sums = {r["j"]: r["v"] for r in rows.select(F.posexplode("s").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return n, [int(sums[j]) for j in range(size)] if sums else [0] * size


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 16) -> DataFrame:
    """Whitened coordinates of every usable row: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.

    The fit list is each distinct vector once, so copies weigh nothing.  Partitions find spectra by centred rank-one
    updates (:class:`Spectrum`); the combined vectors are the basis of a last Rayleigh-Ritz step over all rows, which takes
    from them what rounding left.  Components with no variance (under a 10^-12 of the trace) are not given, so a table
    of no rows, or of one distinct vector, has none.  ``deviation`` is null where it passes 64 bits.  Rows with a null or
    repeated id have their own rows.
    """
    held, size = vectors(rows, id_col, vector_col)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not size:
        return rows.sparkSession.createDataFrame([], kind)
    fit = cut(held.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, size)
    center = np.array([(s - SHIFT * n) / n for s in sums])
    basis = spectra(fit, size).vectors
    total, products = _moments(fit, center, basis)
    covariance = products / n - np.outer(total / n, total / n)
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    kept = [i for i in np.argsort(-values, kind="stable")[:top].tolist() if values[i] > RANK * trace]
    if not kept:
        return rows.sparkSession.createDataFrame([], kind)
    white = (basis @ turn[:, kept]) / np.sqrt(values[kept])
    explained = (values[kept] / trace).tolist()
    total, products = _moments(fit, center, white)
    error = float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(len(kept))).max())
    whole = np.array(sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(kept)
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                some = batch.slice(lo, 2000)
                x = _matrix(some.column(1))
                y = (x - SHIFT - center) @ white
                m = len(x)
                arrays = [
                    some.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n), pa.int64()), pa.array([v for v in _deviation(x, n, whole) for _ in range(k)], pa.int64()),
                    pa.array(y.ravel(), pa.float64()), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, kind)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, in 64 bits where it is sure to fit, else in numbers of any size."""
    most = int(np.abs(x - SHIFT).max(initial=0)) * n + max(abs(int(s) - SHIFT * n) for s in sums)
    if most * most * x.shape[1] < 1 << 63:
        shifted = np.array([int(s) - SHIFT * n for s in sums], np.int64)
        d = n * (x - SHIFT) - shifted
        return (d * d).sum(1).tolist()
    out = [sum((n * v - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]
