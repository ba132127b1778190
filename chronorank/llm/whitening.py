"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronorank.shared import materialize

# How an entry becomes a whole number.
SCALE, OFFSET = 1024, 100_000
#: Entries whose number is not below this in size count as not finite.
LARGEST = 2.0**45
COMPONENTS = 8
#: Bytes of the numbers of a stored block.
BLOCK_BYTES = 4 << 20
#: Residual of a singular triple, of the largest deviation, at which it counts as found.
FOUND = 1e-14

BLOCKS = "dims int, rows int, ids array<long>, numbers binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid rows of (vec_id, embedding), as whole numbers, in blocks of one length each."""
    for batch in batches:
        given = batch.column("embedding")
        widths = np.diff(given.offsets.to_numpy())
        flat = given.values.slice(given.offsets[0].as_py(), int(widths.sum()))
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        with np.errstate(over="ignore", invalid="ignore"):
            numbers = np.floor(SCALE * values) + OFFSET
            bad = np.r_[0, np.cumsum(~(np.abs(numbers) < LARGEST))]
        starts = np.r_[0, np.cumsum(widths)]
        valid = given.is_valid().to_numpy(zero_copy_only=False) & (widths > 0) & (bad[starts[1:]] == bad[starts[:-1]])
        ids = batch.column("vec_id")
        for dims in np.unique(widths[valid]).tolist():
            rows = np.flatnonzero(valid & (widths == dims))
            for at in range(0, len(rows), step := max(1, BLOCK_BYTES // (8 * dims))):
                own = rows[at : at + step]
                block = numbers[starts[own][:, None] + np.arange(dims)].astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "dims": pa.array([dims], pa.int32()),
                        "rows": pa.array([len(own)], pa.int32()),
                        "ids": pa.array([ids.take(pa.array(own)).to_pylist()], pa.list_(pa.int64())),
                        "numbers": pa.array([block.tobytes()], pa.binary()),
                    }
                )


def _numbers(batch: pa.RecordBatch, i: int, dims: int) -> np.ndarray:
    return np.frombuffer(batch.column("numbers")[i].as_buffer(), np.int64).reshape(-1, dims)


@dataclass(frozen=True)
class Fit:
    """Number of vectors, exact sums of their numbers, and ``sums // n`` with what it leaves."""

    n: int
    sums: tuple[int, ...]

    @property
    def dims(self) -> int:
        return len(self.sums)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, in whole numbers of any size where 64 bits might not do."""
        means, left = (np.array([f(s, self.n) for s in self.sums], np.int64) for f in (lambda a, b: a // b, lambda a, b: a % b))
        away = x - means
        if int(np.abs(away).max(initial=0)) * self.n >= 2**62:
            away = away.astype(object)
        return away * self.n - left

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``, rounded once."""
        return self.exact(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of ``exact``; None beyond 64 bits."""
        away = self.exact(x)
        if away.dtype != object and np.square(away.astype(np.float64)).sum(axis=1).max(initial=0) < 2.0**62:
            return np.square(away).sum(axis=1).tolist()
        sums = [sum(int(v) ** 2 for v in row) for row in away]
        return [s if s < 2**63 else None for s in sums]


def _sum_of(blocks: DataFrame, dims: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the ``size`` numbers that ``part`` makes of each.

    A task sends one vector, and a vector of sums arrives.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                total += part(_numbers(batch, i, dims))
        yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    parts = blocks.select("numbers").mapInArrow(add, "v array<double>")
    return parts.select(Summarizer.sum(array_to_vector("v")).alias("v")).first()["v"].toArray()


def _away_from(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``vector`` without its parts along ``basis``; twice, as once leaves rounding errors."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def components(blocks: DataFrame, fit: Fit, most: int = COMPONENTS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (dims, k) and eigenvalues (k) of the covariance, largest first, and its trace.

    Golub-Kahan-Lanczos: ``X`` are the centred rows, and ``X v_k = a_k u_k +
    b_(k-1) u_(k-1)``, ``X' u_k = a_k v_k + b_k v_(k+1)`` with orthogonal ``u``
    and ``v``.  A left vector, as long as the table, is never stored: ``u_k = X
    p_k`` for a short ``p_k`` that each task applies to its own rows.  One pass
    over the blocks gives both products, ``X p`` and ``X' (X p)``, as sums of a
    task.  All ``u`` and ``v`` are made orthogonal to all before them.  Where the
    space of ``v`` is closed, a new direction goes on from there.

    Ends when the largest singular triples of the bidiagonal matrix are found
    and what no ``v`` reaches yet is too little to hold a larger one; so equal
    eigenvalues are all found.  That is after ``dims`` passes at most, whatever
    the number of rows.  Deviations that rounding can't tell from 0 are no
    components, so there are fewer than ``most`` where the rows span less.
    """
    dims = fit.dims
    draw = np.random.default_rng(seed)

    def products(p: np.ndarray) -> tuple[np.ndarray, float, float]:
        def part(x: np.ndarray) -> np.ndarray:
            rows = fit.centred(x)
            w = rows @ p
            return np.r_[rows.T @ w, w @ w, np.square(rows).sum()]

        sums = _sum_of(blocks, dims, dims + 2, part)
        return sums[:dims], sums[dims], sums[dims + 1]

    right = np.zeros((dims, 0))  # v
    inner = np.zeros((dims, 0))  # p, with u = X p
    back = np.zeros((dims, 0))  # X' u
    bidiagonal = np.zeros((dims, dims))
    energy, v = 0.0, draw.standard_normal(dims)
    v /= np.linalg.norm(v)
    beta = 0.0
    for k in range(dims):
        right = np.c_[right, v]
        p = v - beta * inner[:, -1] if beta else v
        z, norm2, energy = products(p)
        for _ in range(3):
            # parts along earlier u; a new pass only where most of X p is lost
            along = inner.T @ z
            p = p - inner @ along
            if along @ along <= 0.5 * norm2:
                z, norm2 = z - back @ along, norm2 - along @ along
                break
            z, norm2, energy = products(p)
        # directions that differ from none by more than rounding hold nothing
        alpha = np.sqrt(max(norm2, 0.0))
        if alpha * alpha <= energy * 1e-26:
            alpha, next_v = 0.0, np.zeros(dims)
            inner, back = np.c_[inner, np.zeros(dims)], np.c_[back, np.zeros(dims)]
        else:
            inner, back = np.c_[inner, p / alpha], np.c_[back, z / alpha]
            next_v = _away_from(z / alpha - alpha * v, right)
        bidiagonal[k, k] = alpha
        beta = float(np.linalg.norm(next_v))
        left_vectors, values, _ = np.linalg.svd(bidiagonal[: k + 1, : k + 1])
        top = values[: min(most, k + 1)]
        unseen = max(energy - np.square(bidiagonal[: k + 1, : k + 1]).sum(), 0.0)
        residual = beta * np.abs(left_vectors[k, : len(top)]).max()
        if k + 1 >= most and residual <= FOUND * values[0] and unseen < top[-1] ** 2:
            break
        if k + 1 == dims:
            break
        if beta <= FOUND * np.sqrt(energy):
            beta, next_v = 0.0, np.zeros(dims)
            while (norm := np.linalg.norm(next_v)) < 0.01:
                next_v = _away_from(draw.standard_normal(dims) / np.sqrt(dims), right)
        else:
            norm, bidiagonal[k, k + 1] = beta, beta
        v = next_v / norm
    size = right.shape[1]
    _, values, rows = np.linalg.svd(bidiagonal[:size, :size])
    keep = min(most, int((np.square(values) > energy * 1e-24).sum()))
    vectors = right @ rows[:keep].T
    return vectors / np.linalg.norm(vectors, axis=0), np.square(values[:keep]) / fit.n, energy / fit.n


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of all valid rows of ``vectors``.

    An entry c becomes ``x = floor(1024 * c) + 100000``.  Rows are valid unless
    their embedding is null, empty, or has null or non-finite entries, an ``x``
    of ``LARGEST`` or more included, of which sums would not be exact.  If
    lengths differ, those of the most frequent length (of several, the longest)
    are meant, and the others are dropped too.  All valid rows are the fit list.

    ``deviation`` is null beyond 64 bits.  There are as many components as the
    rows have dimensions and the largest eigenvalues aren't 0: none for a single
    row, for equal rows and for an empty table, which give no rows.  Null and
    repeated ids are vectors of their own; other columns are ignored.

    Rows are stored once as blocks of whole numbers.  Exact sums, each step's
    products and the check of the result are sums over blocks; only vectors and
    matrices of the size of a dimension reach the driver.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    blocks = materialize(rows.mapInArrow(_blocks, BLOCKS), "whitening_blocks")
    lengths = blocks.groupBy("dims").agg(F.sum("rows").alias("n"))
    best = lengths.agg(F.max(F.struct("n", "dims")).alias("most")).first()["most"]
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if best is None:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = blocks.where(F.col("dims") == best["dims"])
    fit = Fit(best["n"], _sums(blocks, best["dims"]))
    axes, values, trace = components(blocks, fit, most)
    scaled = axes / np.sqrt(values)
    explained = values / trace if trace else values
    size = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = fit.centred(x) @ scaled
        return np.r_[white.sum(axis=0), (white.T @ white).ravel()]

    error = 0.0
    if size:
        sums = _sum_of(blocks, fit.dims, size + size * size, moments) / fit.n
        covariance = sums[size:].reshape(size, size) - np.outer(sums[:size], sums[:size])
        error = float(np.abs(covariance - np.eye(size)).max())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows if size else 0):
                x = _numbers(batch, i, fit.dims)
                ids = batch.column("ids")[i].values
                at = np.repeat(np.arange(len(x)), size)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.take(pa.array(at)),
                        "component": pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(at), fit.n, np.int64)),
                        "deviation": pa.array(fit.deviations(x), pa.int64()).take(pa.array(at)),
                        "whitened": pa.array((fit.centred(x) @ scaled).ravel()),
                        "explained": pa.array(np.tile(explained, len(x))),
                        "identity_error": pa.array(np.full(len(at), error)),
                    }
                )

    return blocks.select("ids", "numbers").mapInArrow(score, schema)


def _sums(blocks: DataFrame, dims: int) -> tuple[int, ...]:
    """Exact sums of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _numbers(batch, i, dims)
                step = 2**17  # so many numbers below LARGEST fit in 64 bits
                for at in range(0, len(x), step):
                    yield pa.RecordBatch.from_pydict({"at": pa.array(range(dims), pa.int32()), "x": x[at : at + step].sum(axis=0)})

    parts = blocks.select("numbers").mapInArrow(add, "at int, x long")
    found = parts.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    return tuple(int(row["s"]) for row in sorted(found))
