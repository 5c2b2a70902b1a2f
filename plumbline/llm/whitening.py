"""Whitening of embeddings by shifted CholeskyQR over integer vectors.

The rows that the covariance is taken over (each distinct vector once) are never
gathered. Every pass sends the triangular factors found so far to the tasks,
orthogonalises the centred rows by triangular solves and sums one d x d Gram
matrix; the driver takes its Cholesky factor. The first factor is shifted, so
that rounding or dependent columns cannot break it; a later one is shifted only
where it has to be. The product of the factors is the R of a QR decomposition of
the centred rows, and its SVD has their singular values and right singular
vectors, at the precision of the rows and not at that of a squared matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, tidy

SCALE = 256
COMPONENTS = 4
#: Departure of the orthogonalised rows from orthonormal ones (or from a projection, where columns depend on each other) that ends the passes.
TOLERANCE, MOST_PASSES = 1e-12, 12
#: A component counts if its variance is more than this share of the largest one. Where columns depend on each other, every factor takes what R holds
#: of such a direction down by its shift's square root, so after so many factors it is far below.
LEAST_VARIANCE, FACTORS_IF_DEPENDENT = 1e-18, 4
#: Columns that one triangular solve treats at once.
BLOCK = 64
#: Rows that are worked on at once.
ROWS_AT_ONCE = 4096
#: Integers up to this one are whole doubles and may be squared and summed in 64 bits.
WHOLE = 1 << 63


class Whitening(NamedTuple):
    """``components``: one unit column each, by falling ``variances``; ``trace``: all variance; ``n`` and ``sums``: of the distinct vectors."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    passes: int


def quantized(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with ``x``, the vector times 256 as whole numbers; rows with a null vector or a null, NaN or infinite entry are left out."""
    entry = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    kept = rows.filter(F.col(vec_col).isNotNull() & ~F.exists(vec_col, entry) & (F.size(vec_col) > 0))
    return kept.withColumn("x", F.transform(vec_col, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    """Rows of d whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _portions(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(lo, ROWS_AT_ONCE)
            yield part, _vectors(part.column("x"), d)


def solve_upper(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, by substitution."""
    out, d = np.empty_like(rows), r.shape[0]
    for lo in range(0, d, BLOCK):
        hi = min(lo + BLOCK, d)
        part = rows[:, lo:hi] - out[:, :lo] @ r[:lo, lo:hi]
        for j in range(lo, hi):
            out[:, j] = (part[:, j - lo] - out[:, lo:j] @ r[lo:j, j]) / r[j, j]
    return out


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - mean, where the mean is ``whole`` + ``rest``: the whole part is taken off exactly."""
    return (x - whole).astype(np.float64) - rest


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _size_and_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and sums of the columns, as whole numbers of any size: both halves of 64 bits are summed apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _portions(batches, d):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    parts = fit.mapInArrow(run, "i int, n bigint, high bigint, low bigint")
    sums = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()
    return (int(sums[0]["n"]) if sums else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in sums]


def _gram(fit: DataFrame, d: int, k: int, n: int, sums: list[int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Of the matrix ``of`` (centred rows), k columns wide: its Gram matrix, and its column sums as one more row.

    A task sends k + 1 rows of k numbers, whatever its input; each row of the
    sum is made by one task.
    """
    whole, rest = _mean(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _portions(batches, d):
            m = of(centred(x, whole, rest))
            total[:k] += m.T @ m
            total[k] += m.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = _vectors(table.column("row"), k)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    kind = "i int, row array<double>"
    rows = fit.mapInArrow(tidy(run), kind).groupBy("i").applyInArrow(add, kind).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor; if it does not exist, that of the matrix with a greater shift."""
    size = float(np.linalg.norm(gram, 2)) or 1.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(11.0 * len(gram) * (len(gram) + 1) * np.finfo(float).eps * size, 10 * shift)


def triangular_factor(fit: DataFrame, d: int, n: int, sums: list[int]) -> tuple[np.ndarray, int]:
    """R of the centred rows and the number of Gram passes that it took."""
    factors: list[np.ndarray] = []

    def orthogonalised(rows: np.ndarray) -> np.ndarray:
        for r in factors:
            rows = solve_upper(rows, r)
        return rows

    for done in range(1, MOST_PASSES + 1):
        gram = _gram(fit, d, d, n, sums, orthogonalised)[:d]
        gram = (gram + gram.T) / 2
        if not gram.any():                               # all rows are equal
            return np.zeros((d, d)), done
        off = float(np.abs(gram @ gram - gram).max())
        dependent = float(np.linalg.eigvalsh(gram)[0]) < 0.5
        if factors and off <= TOLERANCE and (not dependent or len(factors) >= FACTORS_IF_DEPENDENT):
            break
        first = 11.0 * (n * d + d * (d + 1)) * np.finfo(float).eps * float(np.linalg.norm(gram, 2))
        factors.append(_factor(gram, 0.0 if factors else first))
    else:
        if off > TOLERANCE ** 0.5:
            raise ArithmeticError(f"rows not orthogonal after {MOST_PASSES} passes: {off:.3g}")
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    return r, done


def fit(rows: DataFrame, vec_col: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The usable rows with ``x``, and their whitening; None if there is no usable row.

    An entry that a vector lacks counts as null: rows of fewer entries than the
    longest usable vector are left out too. There are fewer than ``k``
    components where the rows span fewer dimensions, and none where all are
    equal.
    """
    usable = quantized(rows, vec_col)
    distinct = materialize(usable.select("x").distinct())
    d = distinct.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        return usable, None
    usable, distinct = usable.filter(F.size("x") == d), distinct.filter(F.size("x") == d)
    n, sums = _size_and_sums(distinct, d)
    r, passes = triangular_factor(distinct, d, n, sums)
    _, singular, right = np.linalg.svd(r)
    variances = singular ** 2 / n
    k = min(k, int((variances > variances[0] * LEAST_VARIANCE).sum())) if variances[0] > 0 else 0
    components = right[:k].T.copy()
    components *= np.where(components[np.abs(components).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0) if k else 1.0
    error = 0.0
    if k:
        scaled = components / np.sqrt(variances[:k])
        both = _gram(distinct, d, k, n, sums, lambda a: a @ scaled)
        mean = both[k] / n
        error = float(np.abs(both[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return usable, Whitening(n, sums, components, variances[:k], float(variances.sum()), error, passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact; None where that is beyond 64 bits."""
    most = n * int(max(x.max(), -int(x.min()))) + max(abs(s) for s in sums) if len(x) else 0
    if most * most * x.shape[1] < WHOLE:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < WHOLE else None for v in exact]


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component up to ``k``: vec_id, component, n, deviation, whitened, explained, identity_error.

    A row is usable if its vector is not null or empty, has no null, NaN or
    infinite entry, and as many entries as the longest such vector. Each
    distinct vector counts once in the fit, so copies change nothing; rows that
    repeat an id, also a null one, each give their rows. Entries times 256
    beyond 64 bits become the nearest 64-bit number; a ``deviation`` beyond 64
    bits is null. Without usable rows, or if all vectors are equal, there are no
    rows. Other columns are ignored.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    usable, model = fit(named, k=k)
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema)
    d, c = model.components.shape
    whole, rest = _mean(model.n, model.sums)
    scaled, explained = model.components / np.sqrt(model.variances), model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _portions(batches, d):
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), c))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(take), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array([model.n] * (m * c), pa.int64()),
                 pa.array(deviations(x, model.n, model.sums), pa.int64()).take(take), pa.array((centred(x, whole, rest) @ scaled).ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * c, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.select("vec_id", "x").mapInArrow(run, schema)
