"""Whitening of embeddings by matrix-free block subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.llm.common import cut, shuffle_partitions

#: Whole numbers are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Residual, as a share of the eigenvalue, at which a component is certified; what rounding leaves, as a share of the first eigenvalue.
TOLERANCE, ROUNDING = 1e-12, 1e-14
#: Passes of one Chebyshev cycle, and passes after which the block is doubled.
CYCLE, PATIENCE = 8, 120
#: Bytes of a slab of rows, of the slabs that a task of a pass reads, and of the partial products that the driver adds up.
SLAB_BYTES, TASK_BYTES, GATHER_BYTES = 1 << 20, 2 << 20, 64 << 20


@dataclass
class Spectrum:
    """Eigenvalues in falling order, unit eigenvectors as columns, the trace, their residuals, and the passes that it took."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def spread(nodes: np.ndarray) -> list[float]:
    """Nodes in such an order that the products of what is left of them stay in bounds: each is the farthest from those before it."""
    left, out = [float(x) for x in nodes], []
    while left:
        best = max(left, key=lambda s: sum(np.log(abs(s - o) + 1e-300) for o in out) if out else abs(s))
        out.append(best)
        left.remove(best)
    return out


def subspace_iteration(product: Callable[[np.ndarray], tuple[np.ndarray, float]], width: int, k: int, block: int | None = None, tolerance: float = TOLERANCE, patience: int = PATIENCE) -> Spectrum:
    """The k first eigenpairs of a symmetric matrix V >= 0 that is known only by ``product``: Q -> (V Q, trace of V).

    Each pass multiplies a block of orthonormal columns (2 k by default), turns it by
    Rayleigh-Ritz and measures the residuals of the first k columns.  Unless all are
    certified, the columns of (V - s) Q are orthonormalised by QR for the next pass.
    Shifts s are the nodes of a Chebyshev polynomial on [0, smallest Ritz value of
    the block], so a cycle of passes damps what lies below the block as far as
    possible.  Where the eigenvalues below lie so close that ``patience`` passes do
    not certify, the block is doubled; one as wide as the matrix is exact.
    """
    block = min(width, max(1, block or 2 * k))
    dice = np.random.default_rng(0)
    q = np.linalg.qr(dice.standard_normal((width, block)))[0]
    shifts: list[float] = []
    since = passes = 0
    while True:
        z, trace = product(q)
        passes, since = passes + 1, since + 1
        t = q.T @ z
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        first = slice(0, min(k, width))
        residuals = np.linalg.norm(z[:, first] - q[:, first] * values[first], axis=0)
        fine = residuals <= np.maximum(tolerance * np.abs(values[first]), ROUNDING * abs(values[0]))
        if fine.all() or block == width:
            return Spectrum(values[first], q[:, first], trace, residuals, passes)
        if since >= patience:
            more = min(width, 2 * block)
            q = np.linalg.qr(np.hstack([z, dice.standard_normal((width, more - block))]))[0]
            block, since, shifts = more, 0, []
            continue
        if not shifts:
            top = float(values[-1])
            shifts = spread(top / 2 * (1 + np.cos(np.pi * (2 * np.arange(CYCLE) + 1) / (2 * CYCLE)))) if since > 1 else [0.0]
        q = np.linalg.qr(z - shifts.pop(0) * q)[0]


def _floors(column: pa.ListArray, width: int) -> np.ndarray:
    """floor(64 * c) of every component, shorter vectors padded with zeros."""
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class FitList:
    """Each distinct vector once, as slabs of whole numbers in the shared folder, and what passes over it give."""

    def __init__(self, distinct: DataFrame, width: int, dtype: str, most_rows: int) -> None:
        self.width, self.dtype = width, dtype
        # every pass starts all tasks again, so there are as many as the bytes ask for, not as the shuffle has partitions
        tasks = max(1, min(shuffle_partitions(distinct.sparkSession), -(-most_rows * width * np.dtype(dtype).itemsize // TASK_BYTES)))
        most = max(1, SLAB_BYTES // (max(1, width) * np.dtype(dtype).itemsize))

        def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(0).to_pylist()
                for lo in range(0, len(rows), most):
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(rows[lo : lo + most])], pa.binary()), pa.array([len(rows[lo : lo + most])], pa.int64())], ["slab", "n"])

        self.slabs = cut(distinct.coalesce(tasks).mapInArrow(slabs, "slab binary, n long"))
        self.tasks = self.slabs.rdd.getNumPartitions()
        self._add_up()

    def _add_up(self) -> None:
        """n and the exact sums S of floor(64 * c), in two halves that cannot overflow."""
        width, dtype = self.width, self.dtype

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            high, low, n = np.zeros(width, np.int64), np.zeros(width, np.int64), 0
            for batch in batches:
                for slab in batch.column(0):
                    x = np.frombuffer(slab.as_buffer(), dtype).reshape(-1, width).astype(np.int64)
                    high, low, n = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0), n + len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(high), pa.array(low), pa.array(np.full(width, n, np.int64))], ["dim", "high", "low", "n"])

        found = self.slabs.select("slab").mapInArrow(sums, "dim int, high long, low long, n long").groupBy("dim")
        wide = "decimal(38,0)"
        rows = found.agg(F.sum(F.col("high").cast("decimal(19,0)")).cast(wide).alias("high"), F.sum(F.col("low").cast("decimal(19,0)")).cast(wide).alias("low"), F.sum("n").alias("n")).orderBy("dim").collect()
        self.n = rows[0].n if rows else 0
        self.sums = [(int(r.high) << 32) + int(r.low) for r in rows]
        self.base = np.array([s // self.n for s in self.sums], np.int64) if self.n else np.zeros(width, np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums]) if self.n else np.zeros(width)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole parts are taken off before anything is rounded."""
        return (x - self.base).astype(np.float64) - self.rest

    def total(self, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``partial`` over centred slabs: one product for each task; many of them are added up on executors first."""
        base, rest, width, dtype = self.base, self.rest, self.width, self.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                for slab in batch.column(0):
                    x = np.frombuffer(slab.as_buffer(), dtype).reshape(-1, width).astype(np.int64)
                    out += partial((x - base).astype(np.float64) - rest)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["z"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                for z in batch.column(0):
                    out += np.frombuffer(z.as_buffer()).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["z"])

        parts, tasks = self.slabs.select("slab").mapInArrow(run, "z binary"), self.tasks
        at_once = max(2, GATHER_BYTES // max(1, 8 * shape[0] * shape[1]))
        while tasks > at_once:
            tasks = max(2, int(np.ceil(np.sqrt(tasks))))
            parts = parts.repartition(tasks).mapInArrow(add, "z binary")
        return sum((np.frombuffer(r.z).reshape(shape) for r in parts.collect()), np.zeros(shape))

    def product(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """X'(X Q) / n over centred rows, and the trace of X'X / n, in one pass."""
        out = self.total(lambda x: np.hstack([x.T @ (x @ q), (x * x).sum(0)[:, None]]), (self.width, q.shape[1] + 1)) / self.n
        return out[:, :-1], float(out[:, -1].sum())


def whiten(vectors: DataFrame, k: int = 16, vec_id: str = "vec_id", embedding: str = "embedding", block: int | None = None) -> DataFrame:
    """Every vector projected on the first k principal components, each to unit variance.

    Components c become x = floor(64 * c) + 1,000,000.  Means and covariance are
    those of the distinct x vectors.  Vectors that are null or hold a null or a
    component that is not finite go; shorter vectors count as padded with zeros; a
    row without an id stays, as do repeated rows, which do not weigh in the fit.
    There are no more components than dimensions, and none without variance (so
    none if all vectors are equal; an empty table gives no rows).  Components that
    do not fit a 64-bit number, and deviations that do not, raise OverflowError.
    Other columns are not read.  Equal eigenvalues leave their components free to
    turn within their space.

    Distinct vectors are written once to the shared folder, packed, in as many
    partitions as their bytes ask for.  Each pass of the iteration reads them and
    returns one small product for each task.

    Returns vec_id, component (from 1), n, deviation (sum of (n x - S)^2), whitened,
    explained (share of the trace), identity_error (largest entry of the whitened
    fit list's covariance minus the identity), eigenvalue, passes.
    """
    id_type = vectors.schema[vec_id].dataType
    spark = vectors.sparkSession
    fine = F.col(embedding).isNotNull() & ~F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(fine).select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    count, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    long = [StructField(c, LongType()) for c in ("n", "deviation")]
    schema = StructType([StructField("vec_id", id_type), *StructType.fromDDL("component int"), *long, *StructType.fromDDL("whitened double, explained double, identity_error double, eigenvalue double, passes int")])
    if not count or not width:
        return spark.createDataFrame([], schema)
    if most is not None and most >= 2**56:
        raise OverflowError(f"a component of {most} is too large for whole numbers of 64 bits")
    dtype = "<i2" if (most or 0) < 500 else "<i4" if (most or 0) < 1 << 24 else "<i8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(_floors(batch.column(0), width).astype(dtype))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    fit = FitList(rows.select("v").mapInArrow(pack, "x binary").distinct(), width, dtype, count)
    found = subspace_iteration(fit.product, width, k, block)
    real = found.values > 8 * width * np.finfo(np.float64).eps * max(found.values[0], 0)
    values, axes = found.values[real], found.vectors[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(values))] < 0, -1, 1)
    turn = axes / np.sqrt(values)
    white = fit.total(lambda x: (lambda y: np.vstack([y.T @ y, y.sum(0)[None, :]]))(x @ turn), (len(values) + 1, len(values))) / fit.n
    error = float(np.abs(white[:-1] - np.outer(white[-1], white[-1]) - np.eye(len(values))).max())
    n, sums, explained, passes = fit.n, fit.sums, values / found.trace, found.passes
    base, rest, parts = fit.base, fit.rest, len(values)
    shared = spark.sparkContext.broadcast((turn, values, explained, base, rest, sums))  # as many numbers as components and dimensions

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, values, explained, base, rest, sums = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 4096):
                batch = whole.slice(lo, 4096)
                x = _floors(batch.column(1), width)
                white = ((x - base).astype(np.float64) - rest) @ turn
                far = _deviations(x, n, sums)
                m = len(batch)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), parts))),
                    pa.array(np.tile(np.arange(1, parts + 1), m), pa.int32()),
                    pa.array(np.full(m * parts, n, np.int64)),
                    pa.array(np.repeat(far, parts)),
                    pa.array(white.reshape(-1)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * parts, error)),
                    pa.array(np.tile(values, m)),
                    pa.array(np.full(m * parts, passes), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(project, schema)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum of (n x - S)^2 for each row, exact: in 64 bits where they suffice, else in long integers."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    reach = max(max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), sums))
    if x.shape[1] * reach * reach < 2**63 and n * max(int(x.max()), -int(x.min()), 1) < 2**63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1)
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    if max(exact) >= 2**63:
        raise OverflowError("a deviation does not fit a 64-bit number")
    return np.array(exact, np.int64)
