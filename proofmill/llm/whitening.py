"""Embedding whitening by one-sided Jacobi SVD.

Components become integers on a grid first, so that sums and centred differences are exact. Each distinct grid vector is fitted
once. Every task compresses its centred rows, block after block, to an upper triangular R (QR of the R so far on top of the next
block); R's of 16 tasks at a time are stacked and compressed again until one is left, whose Gram matrix is that of all rows. Plane
rotations then orthogonalise R's columns, dealt in rounds of disjoint pairs; the accumulated rotations are the components, the
columns' lengths over sqrt(n) the standard deviations. No covariance is formed to find them, so small deviations keep their
digits. The identity error is a measurement: the covariance of the whitened rows, summed up from co-moments that each block
centres at its own mean.

Defined results: rows whose vector is null or holds null or non-finite entries are left out. A null id is kept like any other, and rows that repeat
an id or a vector are all returned. Each vector length has a fit of its own; an empty vector has no component and no row. A component
without variance (equal rows, fewer rows than dimensions, dependent dimensions) has a null `whitened`, an `explained` of 0 and takes no part in
the identity error, which is null where no component has variance. Entries beyond +-2^53 on the grid count as that bound; a deviation
beyond the range of long is null. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

#: Grid steps of a unit, the grid's origin, and the largest step.
STEPS, ORIGIN, LARGEST = 64, 1_000_000, 1 << 53
#: Rows that are compressed at once, and R's that are stacked at once.
ROWS, STACK = 2048, 16
#: Numbers of a batch's longest row of output.
EPS = np.finfo(np.float64).eps


def grid(vector: Column) -> Column:
    """Whole steps of each component as long; null for a vector that is null or holds null or non-finite components."""
    v = vector.cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = lambda c: F.floor(F.greatest(F.least(c * STEPS, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + ORIGIN
    return F.when(good, F.transform(v, step))


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - sums for each row, exact: as int64 where all of it fits, else as Python integers."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond long."""
    most = int(np.abs(d).max(initial=0))
    if d.dtype != object and most * most * max(d.shape[1], 1) < 1 << 63:
        return (d * d).sum(1).tolist()
    found = (sum(int(v) * int(v) for v in row) for row in d.tolist())
    return [v if v < 1 << 63 else None for v in found]


def compress(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of r on top of rows; at most as many rows as columns."""
    return np.linalg.qr(np.concatenate([r, rows]), mode="r")


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of r's columns made orthogonal by plane rotations, largest first, and the accumulated rotations in that order.

    A sweep deals the columns into rounds of disjoint pairs (a round robin), so a round is one step over whole arrays.
    """
    d = r.shape[1]
    size = d + d % 2
    a = np.zeros((max(len(r), 1), size))
    a[: len(r), :d] = r
    v = np.eye(size)
    order = np.arange(size)
    for _ in range(sweeps):
        rotated = False
        # Rounding of columns that are null beside the largest is not rotated for ever.
        floor = EPS * EPS * max((a * a).sum(0).max(initial=0), 1e-300)
        for _ in range(size - 1):
            p, q = order[: size // 2], order[::-1][: size // 2]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = (np.abs(gamma) > EPS * np.sqrt(alpha * beta)) & (np.abs(gamma) > floor)
            if turn.any():
                rotated = True
                zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = np.where(turn, 1 / np.hypot(1, t), 1.0)
                s = np.where(turn, t, 0.0) * c
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                vx, vy = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vx - s * vy, s * vx + c * vy
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not rotated:
            break
    lengths = np.sqrt((a * a).sum(0))[:d]
    first = np.argsort(-lengths, kind="stable")
    return lengths[first], v[:d, :d][:, first]


class Fit:
    """Count, sums, and up to `top` components of one vector length; a few numbers for each dimension, so it travels with the tasks."""

    def __init__(self, n: int, sums: np.ndarray, top: int):
        self.n, self.sums, self.count = n, sums, min(top, len(sums))
        self.error: float | None = None

    def solve(self, r: np.ndarray) -> None:
        lengths, v = jacobi(r)
        square = lengths**2
        lengths[lengths <= len(lengths) * 8 * EPS * lengths.max(initial=0)] = 0
        self.explained = np.where(lengths > 0, square / max(square.sum(), 1e-300), 0)[: self.count]
        self.some = lengths[: self.count] > 0
        deviation = lengths[: self.count] / np.sqrt(self.n)
        self.components = v[:, : self.count]
        self.map = np.where(self.some, self.components / np.where(self.some, deviation, 1), 0)

    def centred(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n).astype(np.float64)

    def whitened(self, d: np.ndarray) -> np.ndarray:
        return self.centred(d) @ self.map


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions in the column, and the vectors as rows."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == d)
        out[d] = own, flat[at[own][:, None] + np.arange(d)]
    return out


def _matrix(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, columns)


def _by_task(rows: DataFrame, start: Callable, add: Callable, scratch: Scratch, merge: Callable, name: str) -> dict[int, np.ndarray]:
    """One matrix for each vector length: summed up in each task over its rows, then merged STACK at a time.

    start(d) is the empty matrix, add(d, matrix, vectors) takes vectors in, merge(d, a, b) joins two.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, (_, x) in _vectors(b.column(0)).items():
                for i in range(0, len(x), ROWS):
                    held[d] = add(d, held.get(d, start(d)), x[i : i + ROWS])
        part = pyspark.TaskContext.get().partitionId()
        for d, m in held.items():
            yield pa.record_batch([pa.array([d], pa.int32()), pa.array([part], pa.int64()), pa.array([m.astype("<f8").tobytes()])], ["d", "part", "m"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in ("d", "part", "m")), strict=True):
                d, part, m = key[0], key[1] // STACK, _matrix(key[2], start(key[0]).shape[1])
                if now == (d, part):
                    held = merge(d, held, m)
                else:
                    if now:
                        yield pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([held.astype("<f8").tobytes()])], ["d", "part", "m"])
                    now, held = (d, part), m
        if now:
            yield pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([held.astype("<f8").tobytes()])], ["d", "part", "m"])

    schema = "d int, part long, m binary"
    parts = rows.rdd.getNumPartitions()
    made = scratch.write(rows.mapInArrow(local, schema), name)
    while parts > 1:
        group = F.floor(F.col("part") / STACK)
        made = scratch.write(made.repartition("d", group).sortWithinPartitions("d", "part").mapInArrow(merged, schema), name)
        parts = -(-parts // STACK)
    return {r.d: _matrix(bytes(r.m), start(r.d).shape[1]) for r in made.collect()}


def fit_whitening(vectors: DataFrame, scratch: Scratch, top: int = 16, vec_col: str = "embedding") -> dict[int, Fit]:
    """The fit of each vector length: over its distinct grid vectors."""
    bounded_batches(vectors.sparkSession)
    fit = scratch.write(vectors.select(grid(F.col(vec_col)).alias("x")).where("size(x) > 0").distinct(), "fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and sums of each length in this task; halves of 32 bits keep the sums exact."""
        held: dict[int, list] = {}
        for b in batches:
            for d, (own, x) in _vectors(b.column(0)).items():
                h = held.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                h[0] += len(own)
                h[1] += (x >> 32).sum(0)
                h[2] += (x & 0xFFFFFFFF).sum(0)
        for d, (n, high, low) in held.items():
            yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["d", "i", "n", "high", "low"])

    # A few numbers for each dimension.
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    total = fit.mapInArrow(sums, "d int, i int, n long, high long, low long").groupBy("d", "i").agg(F.sum("n").alias("n"), exact("high"), exact("low"))
    found: dict[int, list] = {}
    for r in sorted(total.collect()):
        found.setdefault(r.d, []).append((r.n, (int(r.high) << 32) + int(r.low)))
    fits = {d: Fit(rows[0][0], np.array([s for _, s in rows], object), top) for d, rows in found.items()}
    if not fits:
        return fits

    centred = lambda d, x: fits[d].centred(differences(x, fits[d].n, fits[d].sums))
    r = _by_task(fit, lambda d: np.zeros((0, d)), lambda d, m, x: compress(m, centred(d, x)), scratch, lambda _, a, b: compress(a, b), "r")
    for d, m in r.items():
        fits[d].solve(m)

    # Rows of a co-moment: the count, the mean, then the centred products.
    def joined(_: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = a[0, 0], b[0, 0]
        apart = b[1] - a[1]
        out = a + b
        out[1] = a[1] + apart * (nb / max(na + nb, 1))
        out[2:] += np.outer(apart, apart) * (na * nb / max(na + nb, 1))
        return out

    def comoment(d: int, m: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = fits[d].whitened(differences(x, fits[d].n, fits[d].sums))
        mean = w.mean(0)
        own = np.concatenate([np.full((1, w.shape[1]), len(w)), mean[None], (w - mean).T @ (w - mean)])
        return joined(d, m, own)

    for d, m in _by_task(fit, lambda d: np.zeros((2 + fits[d].count, fits[d].count)), comoment, scratch, joined, "moment").items():
        f = fits[d]
        off = np.abs(m[2:] / f.n - np.eye(f.count))[np.ix_(f.some, f.some)]
        f.error = float(off.max()) if off.size else None
    return fits


def whiten(vectors: DataFrame, top: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns id_col, component, n, deviation, whitened, explained, identity_error: one row for each usable row and component."""
    fits = fit_whitening(vectors, Scratch(vectors.sparkSession, "whitening"), top, vec_col)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, (own, x) in _vectors(b.column(1)).items():
                f = fits[d]
                diff = differences(x, f.n, f.sums)
                k, w = f.count, f.whitened(diff)
                times = np.repeat(np.arange(len(own)), k)
                some = np.tile(f.some, len(own))
                out = [
                    b.column(0).take(pa.array(own)).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(len(times), f.n)),
                    pa.array(squares(diff), pa.int64()).take(pa.array(times)), pa.array(w.ravel(), mask=~some), pa.array(np.tile(f.explained, len(own))), pa.array([f.error] * len(times), pa.float64()),
                ]
                yield pa.record_batch(out, names)

    usable = vectors.select(F.col(id_col).cast("long").alias("id"), grid(F.col(vec_col)).alias("x")).where("size(x) > 0")
    made = usable.mapInArrow(rows, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return made.withColumnRenamed("id", id_col)
