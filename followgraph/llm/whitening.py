"""Whitening of embeddings by shifted CholeskyQR.

Every entry c becomes the integer floor(``SCALE`` * c) + ``OFFSET``. The centred rows A are orthogonalised in passes over the table: a pass
sums the Gram matrix of the rows so far, its Cholesky factor R is applied to every row by a triangular solve, and the next pass starts from
there, until the Gram matrix is the identity. The first Gram matrix is shifted, so that its factor exists however close to dependent the dimensions are.
The product of all factors is the R of A = QR; its singular values and vectors are those of A, so the condition of the covariance is never squared.

Rows are centred before they are multiplied: sums are exact integers, and what is subtracted from a row is the integer part of the mean first.
Only sums, Gram matrices and factors (at most ``MAX_DIMS`` squared numbers) reach the driver; they don't grow with the rows.

Rows take part if their vector is neither null nor empty, has no null or non-finite entry and none beyond ``LIMIT`` (its integer would not be
exact), and has the table's most frequent number of dimensions (ties: the larger one). Others are left out. Rows without ``vec_id`` and repeated rows
count like any other. Dependent or constant dimensions give fewer components; a table without rows, or of equal rows, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from followgraph.session import written

SCALE = 64
OFFSET = 1_000_000
LIMIT = 2.0**40  # of an entry's size
COMPONENTS = 32
MAX_DIMS = 2048
_PASSES = 8
_NULL = 1e-11  # what a Gram matrix after the first pass has along a dependent direction is below this
_ENTRIES = 1 << 20  # entries of a matrix worked on at once
_PANEL = 64


@dataclass
class Whitening:
    """What was fitted: ``components`` (one a row) with their eigenvalues, for integer vectors with these sums."""

    n: int
    sums: list[int]
    largest: int  # distance of an entry from the integer part of its mean
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace else self.eigenvalues


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, as a written table of integer vectors."""
    entry = lambda x: x.cast("double")
    usable = embeddings.where(F.forall("embedding", lambda x: F.coalesce(F.abs(entry(x)) <= LIMIT, F.lit(False))))
    usable = usable.where(F.size("embedding") > 0)
    most = usable.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).head()
    dims = most["dims"] if most else 0
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; Gram matrices are kept for {MAX_DIMS} at most")
    integers = F.transform("embedding", lambda x: F.floor(entry(x) * SCALE).cast("bigint") + OFFSET)
    usable = usable.where(F.size("embedding") == dims)
    return written(usable.select(F.col("vec_id").cast("bigint"), integers.alias("v")), "integer-vectors")


def _matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices of bounded size."""
    if not len(column):
        return
    flat = column.flatten().to_numpy().reshape(len(column), -1)
    step = max(1, _ENTRIES // flat.shape[1])
    for low in range(0, len(flat), step):
        yield flat[low : low + step]


def _totals(vectors: DataFrame) -> tuple[int, list[int], int]:
    """Rows, the exact sum of each dimension, and how far an entry is from the integer part of its mean at most."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, None, None, None
        for batch in batches:
            for x in _matrices(batch.column(0)):
                n += len(x)
                # at most 2^20 entries below 2^47 in a sum
                sums = x.sum(axis=0).astype(object) + (0 if sums is None else sums)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(low)), pa.int32()),
                    pa.array([n] * len(low), pa.int64()),
                    pa.array([int(s) for s in sums], pa.decimal128(38, 0)),
                    pa.array(low),
                    pa.array(high),
                ],
                names=["dim", "n", "total", "low", "high"],
            )

    parts = vectors.select("v").mapInArrow(partial, "dim int, n bigint, total decimal(38,0), low bigint, high bigint")
    rows = parts.groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    ).orderBy("dim").collect()  # one row a dimension
    if not rows:
        return 0, [], 0
    n, sums = rows[0]["n"], [int(r["total"]) for r in rows]
    return n, sums, max(max(abs(r["low"] - s // n), abs(r["high"] - s // n)) for r, s in zip(rows, sums))


def _centre(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Subtracts the mean: its integer part exactly, then the rest, which is less than one."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole) - rest


def _gram(vectors: DataFrame, mapped: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """The Gram matrix of all mapped rows: one partial matrix a task, whose cells Spark adds up."""
    upper = np.triu_indices(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _matrices(batch.column(0)):
                y = mapped(x)
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            cells = [pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])]
            yield pa.RecordBatch.from_arrays(cells, names=["cell", "value"])

    cells = vectors.select("v").mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = cells.toArrow()
    gram = np.zeros((dims, dims))
    place = cells.column("cell").to_numpy()
    gram[upper[0][place], upper[1][place]] = cells.column("value").to_numpy()
    return gram + np.triu(gram, 1).T


def _solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = Y for an upper triangular R, by panels of columns."""
    q = np.empty(y.shape, order="F")
    for low in range(0, len(r), _PANEL):
        high = min(len(r), low + _PANEL)
        panel = y[:, low:high] - q[:, :low] @ r[:low, low:high]
        for j in range(high - low):
            q[:, low + j] = (panel[:, j] - q[:, low : low + j] @ r[low : low + j, low + j]) / r[low + j, low + j]
    return q


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of the Gram matrix with its diagonal scaled to one and shifted."""
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1
    return np.linalg.cholesky(gram / np.outer(scale, scale) + shift * np.eye(len(gram))).T * scale


def fit(vectors: DataFrame) -> Whitening:
    """Principal axes of the integer vectors of a written table, by falling eigenvalue."""
    n, sums, largest = _totals(vectors)
    dims = len(sums)
    none = Whitening(n, sums, largest, np.zeros(0), np.zeros((0, dims)), 0.0)
    if not largest:
        return none
    centre = _centre(n, sums)
    steps: list[tuple[str, np.ndarray]] = []

    def mapped(x: np.ndarray) -> np.ndarray:
        y = centre(x)
        for kind, m in steps:
            y = _solved(y, m) if kind == "solve" else y @ m
        return y

    gram = _gram(vectors, mapped, dims)
    # the bound of the rounding error of a Gram matrix; blocks are summed apart, so errors grow with the root of the rows
    unit = np.finfo(float).eps / 2
    shift = 11 * (dims * np.sqrt(n) + dims * (dims + 1)) * unit * dims
    r = _factor(gram, shift)
    steps.append(("solve", r))
    composed = r
    for turn in range(_PASSES):
        gram = _gram(vectors, mapped, len(composed))
        if not turn:
            # directions that vanish are dependent: leave them out before they are blown up
            values, axes = np.linalg.eigh(gram)
            if (values < _NULL).any():
                axes = axes[:, values >= _NULL]
                if not axes.shape[1]:
                    return none
                steps.append(("turn", axes))
                composed = axes.T @ composed
                gram = axes.T @ gram @ axes
        done = np.abs(gram - np.eye(len(gram))).max() < 1e-6
        r = _factor(gram, 0.0)
        steps.append(("solve", r))
        composed = r @ composed
        if done:  # the last factor leaves the square of what was off
            break
    else:
        raise ArithmeticError("the rows did not become orthonormal")
    _, singular, axes = np.linalg.svd(composed, full_matrices=False)
    return Whitening(n, sums, largest, singular**2 / n, axes, float((composed**2).sum() / n))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector that takes part and component.

    ``deviation`` (decimal) is the exact sum of (n * x - S)^2 over the dimensions. ``identity_error`` is measured: the largest entry by which
    the covariance of what is returned differs from the identity.
    """
    vectors = integer_vectors(embeddings)
    model = fit(vectors)
    top = min(components, len(model.eigenvalues))
    schema = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not top:
        return vectors.sparkSession.createDataFrame([], schema)
    centre, n = _centre(model.n, model.sums), model.n
    axes = model.components[:top].T / np.sqrt(model.eigenvalues[:top])
    project = lambda x: centre(x) @ axes
    error = float(np.abs(_gram(vectors, project, top) / n - np.eye(top)).max())
    whole = np.array([s // n for s in model.sums], dtype=np.int64)
    rest = np.array([s % n for s in model.sums], dtype=np.int64)
    exact = np.int64 if len(whole) * (n * (model.largest + 1)) ** 2 < 1 << 63 else object
    explained = model.explained[:top]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, low = batch.column(0), 0
            for x in _matrices(batch.column(1)):
                size = len(x) * top
                off = (((x - whole).astype(exact) * n - rest.astype(exact)) ** 2).sum(axis=1)
                off = pa.array(off.tolist(), pa.decimal128(38, 0)) if exact is object else pa.array(off).cast(pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(x)), top))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, len(x)).take(each),
                        pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(size, n)),
                        off.take(each),
                        pa.array(project(x).reshape(-1)),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(size, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                low += len(x)

    return vectors.mapInArrow(rows, schema)
