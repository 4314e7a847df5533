"""Whitening of embeddings by the leading principal components.

Components become whole numbers, ``floor(256 * c)``, packed into bytes; the
distinct packed vectors are the fit list, written once.  Three passes over it
follow, each of which leaves a task as sums whose size depends on the dimension
alone: exact totals of every dimension, the scatter about the mean of all (rows
of a d x d matrix, added up by row), and the covariance of what was whitened.
The driver holds the one d x d matrix: Householder reflections make it
tridiagonal, bisection by Sturm counts finds its leading eigenvalues, inverse
iteration their vectors, those of close eigenvalues made orthogonal to one
another.  Mean and components then go to every task for the projection.

Vectors null or holding null or non-finite entries take no part; vectors of
different lengths, empty ones too, are as if the shorter ended in zeros.  Rows
repeated, without an id or under one id each get their rows, but count once in
the fit.  Numbers beyond a long stop at its ends, deviations too.  Components
without variance are left out, so a table of one vector, or none, gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landmosaic.llm.textnum import lean
from landmosaic.llm.vector_blocks import matrix
from landmosaic.storage import materialize

SCALE, COMPONENTS = 256, 4
#: An eigenvalue below this share of the trace is rounding.
ROUNDING = 1e-13
#: Eigenvalues closer than this share of the norm are one cluster.
CLUSTER = 1e-3
TOP = 2**63 - 1


# --- vectors as bytes ------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def whole_numbers(v: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(v * scale)
    out = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)  # the greatest double below 2 ** 63
    out[x >= 2.0**63] = TOP
    return out


def packed(x: np.ndarray) -> pa.Array:
    """Each row as bytes: width of a number, then the numbers up to the last that is not 0. Equal vectors have equal bytes."""
    size = x.shape[1] - np.argmax((x != 0)[:, ::-1], axis=1) if x.shape[1] else np.zeros(len(x), np.int64)
    size[~(x != 0).any(axis=1)] = 0
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = np.where((low >= -(2**15)) & (high < 2**15), 2, np.where((low >= -(2**31)) & (high < 2**31), 4, 8))
    out = np.empty(len(x), object)
    for w, n in {*zip(width.tolist(), size.tolist(), strict=True)}:
        at = np.flatnonzero((width == w) & (size == n))
        block = np.ascontiguousarray(x[at, :n].astype(f"<i{w}")).tobytes()
        out[at] = [bytes([w]) + block[i * n * w : (i + 1) * n * w] for i in range(len(at))]
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of packed rows as int64, padded with zeros to ``dims``."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dims), np.int64)
    kinds = np.array([(r[0], len(r)) for r in rows]).reshape(-1, 2)
    for w, n in {*map(tuple, kinds.tolist())}:
        at = np.flatnonzero((kinds == (w, n)).all(axis=1))
        got = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), n)[:, 1:]
        out[at, : (n - 1) // w] = np.ascontiguousarray(got).view(f"<i{w}")
    return out


def fit_list(vectors: DataFrame, scale: int) -> DataFrame:
    """``x``: every distinct vector of whole numbers once, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([packed(whole_numbers(matrix(pa.chunked_array([batch.column(0)])), scale))], ["x"])

    return materialize(vectors.select("v").mapInArrow(lean(run), "x binary").distinct())


# --- sums over the fit list --------------------------------------------------------


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension; halves of the numbers are added apart, so none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims), pa.int32()), pa.array(np.append(0, high)), pa.array(np.append(n, low))], ["dim", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = fit.mapInArrow(lean(run), "dim int, high long, low long").groupBy("dim").agg(exact("high"), exact("low")).collect()  # one row a dimension
    found = {r["dim"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def scatter(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the vectors less their mean; tasks add up their own vectors, then rows are added in a fixed order."""
    dims = len(mean)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = unpacked(batch.column(0), dims) - mean
            total += x.T @ x
        for at in range(0, dims, 256):
            some = np.arange(at, min(dims, at + 256), dtype=np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * dims, total[some].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(some), lists], ["i", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``i``: one running row is held."""
        i, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["i", "v"])
        for batch in batches:
            for j, row in zip(batch.column(0).to_pylist(), matrix(pa.chunked_array([batch.column(2)])), strict=True):
                if j != i and i is not None:
                    yield done()
                i, total = j, (row.copy() if j != i else total + row)
        if i is not None:
            yield done()

    parts = fit.mapInArrow(lean(own), "i int, v array<double>").select("i", F.spark_partition_id().alias("part"), "v")
    rows = parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(lean(added), "i int, v array<double>").collect()  # the matrix: dims x dims
    out = np.zeros((dims, dims))
    for r in rows:
        out[r["i"]] = r["v"]
    return (out + out.T) / 2


def whitened_covariance(fit: DataFrame, mean: np.ndarray, axes: np.ndarray, n: int) -> np.ndarray:
    """Covariance over the fit list of its projections on ``axes`` (dims x k)."""
    dims, k = axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (unpacked(batch.column(0), dims) - mean) @ axes
            first, second = first + y.sum(axis=0), second + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k), pa.int32()), pa.array(np.append(first, second))], ["at", "s"])

    rows = fit.mapInArrow(lean(run), "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # k + k * k numbers
    sums = np.zeros(k + k * k)
    for r in rows:
        sums[r["at"]] = r["s"] / n
    return sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])


# --- eigenvectors of a symmetric matrix ----------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and the Householder vectors that bring ``a`` there."""
    a = a.copy()
    n = len(a)
    turns = []
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        rest = np.abs(u[1:]).max(initial=0.0)
        if rest > 0:
            top = np.abs(u).max()
            u /= top  # so that squares neither overflow nor vanish
            u[0] += np.copysign(np.sqrt(u @ u), u[0])
            u /= np.sqrt(u @ u)
            block = a[k + 1 :, k + 1 :]
            p = block @ u
            p -= (u @ p) * u
            block -= 2 * (np.outer(u, p) + np.outer(p, u))
            column = a[k + 1 :, k]
            column -= 2 * (u @ column) * u
            a[k, k + 1 :] = column
        else:
            u = np.zeros(n - k - 1)
        turns.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def turned_back(z: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """Vectors (columns) of the tridiagonal matrix in the space of the matrix it came from."""
    z = z.copy()
    for k in range(len(turns) - 1, -1, -1):
        u = turns[k]
        z[k + 1 :] -= 2 * np.outer(u, u @ z[k + 1 :])
    return z


def sturm_counts(diag: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each number in ``at``: the negative pivots of the matrix less that number."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = np.append(0.0, side**2)
    count, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for d, s in zip(diag, squares, strict=True):
        pivot = d - at - s / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diag: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, by bisection until neighbouring doubles."""
    n = len(diag)
    reach = np.append(0, np.abs(side)) + np.append(np.abs(side), 0)
    span = max(float((diag + reach).max() - (diag - reach).min()), np.finfo(float).tiny)
    low, high = np.full(k, (diag - reach).min() - 1e-9 * span), np.full(k, (diag + reach).max() + 1e-9 * span)
    wanted = n - np.arange(k)  # the j-th greatest has n - j below anything above it
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= 4 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high)))).all():
            return middle
        above = sturm_counts(diag, side, middle) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def solved(diag: np.ndarray, side: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """x of (T - value) x = right by elimination with row exchanges; pivots below ``least`` count as that."""
    n = len(diag)
    main, up, upper = diag - value, np.append(side, 0.0), np.zeros(n)  # rows of the triangle: main, first and second above
    x = right.copy()
    for i in range(n - 1):
        below = side[i]
        if abs(below) > abs(main[i]):
            old = main[i], up[i]
            main[i], up[i], upper[i] = below, main[i + 1], up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i]
            f = old[0] / below
            main[i + 1], up[i + 1] = old[1] - f * up[i], -f * upper[i]
        else:
            if abs(main[i]) < least:
                main[i] = least
            f = below / main[i]
            main[i + 1] -= f * up[i]
        x[i + 1] -= f * x[i]
    if abs(main[n - 1]) < least:
        main[n - 1] = least
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (upper[i] * x[i + 2] if i + 2 < n else 0.0)) / main[i]
    return x


def leading_vectors(diag: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues by inverse iteration, orthogonal within a cluster."""
    n = len(diag)
    norm = float(np.abs(diag).max() + 2 * np.abs(side).max(initial=0.0)) or 1.0
    rng = np.random.default_rng(29)
    out = np.zeros((n, len(values)))
    head = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            head = j
        others = out[:, head:j]
        z = rng.normal(size=n)
        for _ in range(6):
            for _ in range(2):  # twice is enough
                z -= others @ (others.T @ z)
            z /= np.sqrt(z @ z)
            z = solved(diag, side, value, z, np.finfo(float).eps * norm)
            z /= np.abs(z).max()
        for _ in range(2):
            z -= others @ (others.T @ z)
        out[:, j] = z / np.sqrt(z @ z)
    return out


def leading_axes(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns, largest entry positive."""
    scale = float(np.abs(a).max()) or 1.0
    diag, side, turns = tridiagonal(a / scale)
    values = leading_values(diag, side, k)
    axes = turned_back(leading_vectors(diag, side, values), turns)
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return values * scale, axes


# --- the operator --------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit found: exact sums, components (columns of ``axes``) and how far the result is from white."""

    scale: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, max(1, self.n))) for s in self.sums])


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding") -> Whitening:
    """The ``components`` leading axes of the distinct vectors, fewer where the rest has no variance."""
    fit = fit_list(usable(vectors, id_col, vector), scale)
    size = F.octet_length("x") - 1
    width = F.conv(F.hex(F.substring("x", 1, 1)), 16, 10).cast("int")
    dims = fit.agg(F.max((size / width).cast("int"))).first()[0] or 0
    n, sums = totals(fit, dims)
    out = Whitening(scale, n, sums, 0.0, np.zeros(0), np.zeros((dims, 0)), 0.0)
    if n and dims:
        spread = scatter(fit, out.mean) / n
        values, axes = leading_axes(spread, min(components, dims))
        out.trace = float(np.trace(spread))
        keep = values > ROUNDING * out.trace
        out.values, out.axes = values[keep], axes[:, keep]
        if keep.any():
            found = whitened_covariance(fit, out.mean, out.axes / np.sqrt(out.values), n)
            out.identity_error = float(np.abs(found - np.eye(len(found))).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over the dimensions of ``(n * x - sum) ** 2``, exact, or the greatest long."""
    most = n * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) + max((abs(s) for s in sums), default=0)
    if most * most * max(1, x.shape[1]) <= TOP:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1, dtype=np.int64)
    d = n * x.astype(object) - np.array(sums, object)
    return np.array([min(int((row * row).sum()), TOP) for row in d], np.int64)


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and component."""
    k, dims = len(model.values), len(model.sums)
    mean, axes, share = model.mean, model.axes / np.sqrt(model.values), model.values / (model.trace or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            got = whole_numbers(matrix(pa.chunked_array([batch.column(1)])), model.scale)[:, :dims]
            x = np.zeros((len(got), dims), np.int64)
            x[:, : got.shape[1]] = got
            y = (x - mean) @ axes
            whole = lambda v: pa.array(np.full(len(x) * k, v))
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), whole(model.n), pa.array(np.repeat(deviations(x, model.n, model.sums), k)), pa.array(y.ravel()), pa.array(np.tile(share, len(x))), whole(model.identity_error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(vectors, id_col, vector).mapInArrow(lean(run), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten_embeddings(vectors: DataFrame) -> DataFrame:
    """Fit and projection of one table."""
    return whiten(vectors, fit_whitening(vectors))
