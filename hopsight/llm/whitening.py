"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the eigenvalues and eigenvectors of its centred scatter matrix and updates them
vector by vector: adding a vector is a rank-one update, whose new eigenvalues are the roots of a secular
equation, with deflation of directions that do not change. Spectra of partitions are combined by further
rank-one updates, one per scaled eigenvector and one for the distance of the means, a bounded number of
spectra a task, until one is left. Scans of all vectors then measure the covariance in that basis
and rotate it (Rayleigh-Ritz) until the measured, whitened covariance is the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, read
from .vectors import by_dimension, finite, scaled, unpacked

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Spectra that one task combines; rows handled at once.
FAN, ROWS = 16, 4096
#: The whitened covariance is this near to the identity, or the best of so many rotations.
NEAR, ROTATIONS = 1e-11, 6
#: Eigenvalues below this share of the largest are zero.
ZERO = 1e-12
_EPS = np.finfo(float).eps


class Spectrum:
    """Number, mean and eigendecomposition of the scatter (values ascending, vectors in columns) of vectors."""

    def __init__(self, dim: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        """One vector more: the scatter grows by n / (n + 1) times the square of its distance from the mean."""
        self.n += 1
        off = x - self.mean
        self.mean += off / self.n
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt((self.n - 1) / self.n))

    def combine(self, other: Spectrum) -> None:
        """The vectors of `other` as well: its scaled eigenvectors, then the distance of the means."""
        if not self.n or not other.n:
            if other.n:
                self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(value) * vector)
        off, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.n / n * other.n))
        self.mean, self.n = self.mean + off * (other.n / n), n

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @staticmethod
    def unpack(data: bytes, dim: int) -> Spectrum:
        flat, out = np.frombuffer(data), Spectrum(dim)
        out.n, out.mean, out.values = int(flat[0]), flat[1:1 + dim].copy(), flat[1 + dim:1 + 2 * dim].copy()
        out.vectors = flat[1 + 2 * dim:].reshape(dim, dim).copy()
        return out


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of q diag(d) q' + v v'.

    Deflation: a direction with next to no share of `v` keeps its pair. Of directions with equal eigenvalues a
    reflection leaves one that has their whole share.
    """
    z = q.T @ v
    size = float(z @ z)
    if size <= 0:
        return d, q
    tiny = 8 * _EPS * max(float(np.abs(d).max()), size)
    moved = np.abs(z) * np.sqrt(size) > tiny
    close = np.flatnonzero(np.diff(d) <= tiny)
    if len(close):
        q = q.copy()
        for group in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
            at = np.arange(group[0], group[-1] + 2)
            at = at[moved[at]]
            if len(at) > 1:  # the reflection takes the group's part of z to its last place
                part = z[at]
                length = np.linalg.norm(part)
                mirror = part.copy()
                mirror[-1] += np.copysign(length, part[-1])
                mirror /= np.linalg.norm(mirror)
                q[:, at] -= 2 * np.outer(q[:, at] @ mirror, mirror)
                z[at] = 0
                z[at[-1]] = -np.copysign(length, part[-1])
                moved[at[:-1]] = False
    keep = np.flatnonzero(moved)
    if not len(keep):
        return d, q
    near, tau = secular_roots(d[keep], z[keep] ** 2)
    poles = d[keep]
    apart = (poles[:, None] - poles[near][None, :]) - tau[None, :]  # pole i - root j, without cancellation
    gaps = poles[None, :] - poles[:, None]
    np.fill_diagonal(gaps, 1.0)
    # weights for which the computed roots are exact; they keep the vectors orthogonal
    weight = np.sqrt(np.abs(np.prod(-apart / gaps, axis=1)))
    inner = np.copysign(weight, z[keep])[:, None] / apart
    inner /= np.linalg.norm(inner, axis=0)
    values, vectors = d.copy(), q.copy()
    values[keep], vectors[:, keep] = poles[near] + tau, q[:, keep] @ inner
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum of w_j / (d_j - x), each as the index of the nearer pole and the distance from it.

    Between two poles the sums over the poles on either side are each fitted by one fraction with the same value and slope;
    a step that leaves the bracket halves it instead.
    """
    m, total = len(d), float(w.sum())
    upper = np.append(d[1:], d[-1] + total)
    half = (upper - d) / 2
    at_half = 1 + (w[None, :] / ((d[None, :] - d[:, None]) - half[:, None])).sum(axis=1)
    right = at_half < 0
    right[-1] = False
    near = np.arange(m) + right
    delta = d[None, :] - d[near][:, None]
    lo, hi = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    if at_half[-1] < 0:
        lo[-1], hi[-1] = half[-1], total
    tau = (lo + hi) / 2
    left, rows = np.tri(m) * w, np.arange(m)
    a, b = delta[rows, rows], np.append(delta[rows[:-1], rows[1:]], total * (1 + 1e-3) + _EPS)
    for _ in range(60):
        part = 1 / (delta - tau[:, None])
        above, below = part @ w, np.einsum("ij,ij->i", part, left)
        f = 1 + above
        # terms of the poles below are negative, those of the poles above positive
        done = (np.abs(f) <= 4 * _EPS * (1 + above - 2 * below)) | (hi - lo <= 2 * _EPS * np.abs(tau))
        if done.all():
            break
        lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
        part *= part
        psi = np.einsum("ij,ij->i", part, left)
        phi = part @ w - psi
        x, y = a - tau, b - tau
        p, r, c = (x + y) * f - x * y * (psi + phi), x * y * f, f - x * psi - y * phi
        root = np.sqrt(np.maximum(p * p - 4 * r * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * r / (p + root))
        new = tau + step
        bad = ~np.isfinite(new) | (new <= lo) | (new >= hi)
        tau = np.where(done, tau, np.where(bad, (lo + hi) / 2, new))
    return near, tau


def _spectra(dim: int) -> Callable:
    """The spectrum of a partition's vectors, under the number of the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        found = Spectrum(dim)
        for batch in batches:
            for x in unpacked(batch.column("ints"), np.int32, dim).astype(np.float64):
                found.add(x)
        if found.n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.pack()], pa.binary())],
                                             names=["part", "state"])
    return run


def _combine(dim: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        found = Spectrum(dim)
        for part in sorted(zip(table.column("part").to_pylist(), table.column("state").to_pylist())):
            found.combine(Spectrum.unpack(part[1], dim))
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), "state": pa.array([found.pack()], pa.binary())})
    return run


def spectrum(table: DataFrame, dim: int) -> Spectrum:
    """The spectrum of all vectors of `table` (ints), combined FAN at a time."""
    states = cut(table.mapInArrow(_spectra(dim), "part long, state binary"))
    last = states.agg(F.max("part")).first()[0]
    while last:
        states = cut(states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_combine(dim), "part long, state binary"))
        last //= FAN
    return Spectrum.unpack(states.first()["state"], dim)


def _whitened(batches: Iterator[pa.RecordBatch], dim: int, centre: tuple, basis: np.ndarray) -> Iterator[tuple]:
    whole, rest = centre
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            ints = unpacked(part.column("ints"), np.int32, dim).astype(np.int64) - whole
            yield part, ints, (ints - rest) @ basis


def _products(dim: int, centre: tuple, basis: np.ndarray) -> Callable:
    """Rows (place, x) of a partition: sums of products of whitened components, and of the components in the last row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        total = np.zeros((k + 1, k))
        for _, _, w in _whitened(batches, dim, centre, basis):
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "x"])
    return run


def covariance(table: DataFrame, dim: int, n: int, centre: tuple, basis: np.ndarray) -> np.ndarray:
    """The covariance of the vectors in `basis`, from one scan; (dim + 1) * dim sums come back."""
    total = np.zeros((basis.shape[1] + 1, basis.shape[1]))
    sums = table.mapInArrow(_products(dim, centre, basis), "place int, x double").groupBy("place").agg(F.sum("x").alias("x"))
    for r in sums.collect():
        total.flat[r["place"]] = r["x"]
    mean = total[-1] / n
    return total[:-1] / n - np.outer(mean, mean)


def _rows(dim: int, centre: tuple, basis: np.ndarray, rest: np.ndarray) -> Callable:
    """(vec_id, squares, mixed, whitened): the sums of squares of x less the whole part of the mean, and of its products with n times the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ints, w in _whitened(batches, dim, centre, basis):
            at = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array((ints * ints).sum(axis=1)), pa.array(ints @ rest),
                                              pa.ListArray.from_arrays(at, pa.array(w.ravel()))], names=["vec_id", "squares", "mixed", "whitened"])
    return run


def _whiten(rows: DataFrame, dim: int) -> DataFrame:
    spark, shape = rows.sparkSession, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    table = scaled(rows, ["vec_id"], SCALE)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)
        for batch in batches:
            total[:dim] += unpacked(batch.column("ints"), np.int32, dim).sum(axis=0, dtype=np.int64)
            total[dim] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(total)], names=["place", "x"])
    found = {r["place"]: int(r["x"]) for r in table.mapInArrow(sums, "place int, x long").groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    n = found[dim]
    whole = np.array([found[i] // n for i in range(dim)], np.int64)
    over = [found[i] - n * int(whole[i]) for i in range(dim)]  # n times the rest of the mean, below n
    centre = whole, np.array(over, float) / n
    if not dim:
        return spark.createDataFrame([], shape)
    start = spectrum(table, dim)
    values, basis = start.values[::-1] / n, np.linalg.qr(start.vectors[:, ::-1])[0]
    best = None
    for turn in range(ROTATIONS + 1):
        rank = int((values > ZERO * max(values.max(), 0)).sum()) if values.max() > 0 else 0
        if not rank:
            return spark.createDataFrame([], shape)
        # a direction without variance is scaled like the last that has some
        scale = np.sqrt(np.maximum(values, values[rank - 1]))
        measured = covariance(table, dim, n, centre, basis / scale)
        k = min(COMPONENTS, rank)
        off = float(np.abs(measured[:k, :k] - np.eye(k)).max())
        rest = np.abs(measured[:k] - np.eye(dim)[:k]).max()
        if best is None or rest < best[0]:
            best = rest, off, values, basis, k
        if rest <= NEAR or turn == ROTATIONS:
            break
        found_values, turned = np.linalg.eigh(measured * np.outer(scale, scale))
        order = np.argsort(found_values)[::-1]
        values, basis = np.maximum(found_values[order], 0), np.linalg.qr(basis @ turned[:, order])[0]
    _, off, values, basis, k = best
    basis = basis[:, :k] * np.sign(basis[np.abs(basis[:, :k]).argmax(axis=0), np.arange(k)])
    share = F.array(*[F.lit(float(v)) for v in values[:k] / values.sum()])
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    out = table.mapInArrow(_rows(dim, centre, basis / np.sqrt(values[:k]), np.array(over, np.int64)),
                           "vec_id long, squares long, mixed long, whitened array<double>")
    out = out.withColumn("deviation", (big(n * n) * F.col("squares") - big(2 * n) * F.col("mixed") + big(sum(x * x for x in over))).cast("decimal(38,0)"))
    return (out.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
            .select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(share, F.col("place") + 1).alias("explained"), F.lit(off).alias("identity_error")))


def whiten(vectors: DataFrame) -> DataFrame:
    """A row per finite vector of `vectors` (vec_id, embedding) and component up to 32: vec_id, component, n, deviation, whitened, explained, identity_error.

    Components become x = floor(64 * c) + 1000000. Over all n such vectors, with sums S, deviation is the exact sum of
    (n * x - S)^2, a decimal; whitened is x - S / n on the component's unit eigenvector of the covariance over the root
    of its eigenvalue; explained is the eigenvalue's share of all; identity_error is the largest entry of the whitened vectors'
    measured covariance less the identity. The entry of largest size of an eigenvector is positive. Components without variance
    are left out, so fewer than 33 vectors have fewer components, and equal ones or a single one none. Null vectors and those
    with a null or non-finite component are left out; a component beyond 2^27 after scaling raises. Vectors of different
    dimension are fits of their own. Null ids stay and repeated rows count each; an empty table gives no rows; other columns are not looked at.
    """
    rows = finite(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    return by_dimension(rows, _whiten, lambda: rows.sparkSession.createDataFrame(
        [], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
