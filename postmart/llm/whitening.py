"""Embedding whitening: Chebyshev-filtered subspace iteration over distributed passes of the centred data."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from postmart.llm.common import Scratch

# Fixed values of the scale: x = floor(SCALE * entry) + SHIFT, held within +-LIMIT.
SCALE, SHIFT, LIMIT = 1024.0, 100_000, 1 << 52
#: Vectors that a task turns into a matrix at once.
BLOCK = 1024
#: Up to so many tasks send their sums to the driver themselves.
FEW_TASKS = 64
#: Columns of the subspace beyond the wanted components, and degree of the filter polynomial.
GUARDS, DEGREE = 24, 8
#: A component is done when its residual is this small against the largest eigenvalue, or no longer falls.
TOLERANCE, MOST_CYCLES = 5e-15, 60
#: Directions with less than this share of the largest variance have none that double precision can tell.
NOTHING = 1e-12


def scaled(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(dims, ids, x): blocks of up to ``BLOCK`` integer vectors of one length, of rows that have a vector of finite
    entries.  ``x`` is a matrix of little-endian integers of 32 bits, or of 64 where they do not fit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.clip(np.floor(SCALE * batch.column("v").flatten().to_numpy(zero_copy_only=False)), -LIMIT, LIMIT).astype(np.int64) + SHIFT
            lengths = pc.list_value_length(batch.column("v")).to_numpy()
            begin, ids = np.cumsum(lengths) - lengths, batch.column("id")
            for dims in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dims)
                for at in range(0, len(mine), BLOCK):
                    own = mine[at : at + BLOCK]
                    x = values[begin[own][:, None] + np.arange(dims)]
                    small = np.abs(x).max() < 1 << 31
                    yield pa.RecordBatch.from_pydict({
                        "dims": pa.array([dims], pa.int32()), "ids": pa.array([ids.take(pa.array(own)).to_pylist()], pa.list_(pa.int64())),
                        "x": pa.array([x.astype("<i4" if small else "<i8").tobytes()], pa.binary()),
                    })

    v = F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad))
    return whole.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).mapInArrow(run, "dims int, ids array<bigint>, x binary")


def _matrices(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer matrix) of each block."""
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
            raw = x.as_buffer()
            yield ids.values, np.frombuffer(raw, f"<i{raw.size // (len(ids) * dims)}").reshape(-1, dims).astype(np.int64)


@dataclass
class Fit:
    """Size and sums of the fit list.  ``centred`` subtracts the mean as its whole part, which is exact, and the
    fraction that is left."""

    n: int
    sums: list[int]

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exactly; NULL where it does not fit into 64 bits."""
        span = max(1, int(np.abs(x).max(initial=0))) * self.n + max(map(abs, self.sums), default=0)
        if span < 1 << 62:
            off = x * np.int64(self.n) - np.array(self.sums, np.int64)
            top = int(np.abs(off).max(initial=0))
            if top * top * self.dims < 1 << 63:
                return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def _summed(rows: DataFrame, tasks: int, dims: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``part``, ``size`` numbers each.  Every task adds up its own to one row; if there are
    many tasks, groups of about a root of their number add up again, so that the driver adds few rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _matrices(batches, dims):
            total += part(x)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(batch.num_rows):
                total += batch.column("sums")[at].values.to_numpy()
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.select("ids", "x").mapInArrow(run, "sums array<double>")
    if tasks > FEW_TASKS:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(again, "sums array<double>")
    return np.add.reduce(np.stack([np.zeros(size), *(row.values.to_numpy() for row in sums.toArrow().column("sums"))]), axis=0)


def fit_list(rows: DataFrame, dims: int) -> Fit:
    """Size and exact sums of each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for _, x in _matrices(batches, dims):
            n, sums = n + len(x), [s + a for s, a in zip(sums, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dims + 1), pa.int32()), "value": pa.array([str(v) for v in (*sums, n)])})

    parts = rows.select("ids", "x").mapInArrow(run, "at int, value string")
    found = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    values = {r["at"]: int(r["value"]) for r in found}
    return Fit(values.get(dims, 0), [values.get(k, 0) for k in range(dims)])


def _ritz(q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues of the subspace from large to small, its basis turned to them, V times it."""
    h = q.T @ z
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, z @ turn


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, z: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of V times q, small on [low, high] and scaled to 1 at ``top``.  z is V times q."""
    centre, half = (low + high) / 2, (high - low) / 2
    sigma = half / (top - centre)
    first = sigma
    before, now = q, (z - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (apply(now) - centre * now) * (after / half) - sigma * after * before
        sigma = after
    return now


def components(apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of V and their unit eigenvectors.  ``apply`` multiplies by V.

    A cycle damps the spectrum below the subspace by a polynomial, orthonormalises by QR and turns the basis to its
    Ritz vectors.  Cycles end when the residual of every wanted component is at the level of rounding, or has
    stopped falling there.  Then fresh random guards go through one more cycle: if they bring up no direction as
    large as the wanted ones, none was missed."""
    width = min(dims, wanted + GUARDS)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(dims, width)))[0]
    values, q, z = _ritz(q, apply(q))
    best, stalled, proved, degree = np.inf, 0, width == dims, DEGREE
    for _ in range(MOST_CYCLES):
        if values[0] <= 0:
            break
        keep = min(wanted, width)
        residual = np.linalg.norm(z[:, :keep] - q[:, :keep] * values[:keep], axis=0).max() / values[0]
        stalled = stalled + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if width == dims or residual <= TOLERANCE or (stalled and best < 1e-13):
            if proved:
                break
            # Guards that know nothing of the cycles so far.
            fresh = rng.normal(size=(dims, width - keep))
            q = np.linalg.qr(np.c_[q[:, :keep], fresh])[0]
            z = apply(q)
            found, q, z = _ritz(q, z)
            proved, stalled = True, 0
            values = found
        if stalled >= 3:
            degree = max(2, degree // 2)  # a steep polynomial loses digits of what it damps least
        high = max(values[-1], values[0] * 1e-10)
        if values[0] - high <= values[0] * 1e-9:
            break  # all of the subspace has one eigenvalue
        y = filtered(apply, q, z, 0.0, high, values[0], degree)
        q = np.linalg.qr(y / np.linalg.norm(y, axis=0).clip(1e-300))[0]
        before = values
        values, q, z = _ritz(q, apply(q))
        if proved and np.any(values[:keep] > before[:keep] + 1e-9 * values[0]):
            proved = False  # a direction came up that had been missed
    return values, q


def whiten(rows: DataFrame, wanted: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``) of each row with a
    vector, for each of its ``wanted`` leading components.

    Vectors are scaled to integers (``scaled``) and stored once.  Their number and sums are exact.  The covariance is
    never formed: every product V Q is a pass over the data in which tasks multiply centred blocks, X'(XQ), and
    Spark adds up; the driver holds dimensions x (wanted + ``GUARDS``) numbers, however many rows there are.

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries are left out, and so are vectors that do not
    have the commonest length (the larger of equally common ones).  Entries beyond 2^52 / 1024 are held there;
    ``deviation`` is NULL where it exceeds 64 bits.  Directions without variance are no components: equal
    vectors only, or a single one, give no rows, as does an empty table.  Repeated rows and NULL ids count as
    they stand; further columns are ignored."""
    scratch = Scratch(rows.sparkSession, "whitening")
    schema = f"{id_col} bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = scratch.store(scaled(rows, id_col, vector_col), "x")
    lengths = vectors.groupBy("dims").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims = int(lengths["dims"])
    vectors = vectors.where(F.col("dims") == dims)
    fit, tasks = fit_list(vectors, dims), vectors.rdd.getNumPartitions()

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = fit.centred(x)
            return (c.T @ (c @ q)).ravel()

        return _summed(vectors, tasks, dims, q.size, part).reshape(q.shape) / fit.n

    trace = float(_summed(vectors, tasks, dims, 1, lambda x: np.array([(fit.centred(x) ** 2).sum()]))[0]) / fit.n
    if not trace > 0:
        return rows.sparkSession.createDataFrame([], schema)
    values, basis = components(apply, dims, wanted)
    k = min(wanted, int((values > NOTHING * values[0]).sum()))
    project = basis[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / trace
    mean = _summed(vectors, tasks, dims, k, lambda x: (fit.centred(x) @ project).sum(axis=0)) / fit.n

    def spread(x: np.ndarray) -> np.ndarray:
        w = fit.centred(x) @ project - mean
        return (w.T @ w).ravel()

    error = float(np.abs(_summed(vectors, tasks, dims, k * k, spread).reshape(k, k) / fit.n - np.eye(k)).max())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, dims):
            each, m = np.repeat(np.arange(len(x)), k), len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, fit.n, np.int64)),
                    pa.array(fit.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array((fit.centred(x) @ project).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                [c.strip().split()[0] for c in schema.split(",")],
            )

    return vectors.select("ids", "x").mapInArrow(run, schema)
