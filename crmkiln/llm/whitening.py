"""Operator 12: whitening of embeddings by the leading eigenvectors of their covariance.

Method. Entries become whole numbers (``floor(1024 c) + 100000``). Tasks sum them; then, centred on the rounded
mean, they sum all products of two dimensions. Both sums are exact whole numbers, so the covariance

    (n * sum(y_i y_j) - sum(y_i) * sum(y_j)) / n**2,   y = x - round(S / n)

is rounded once and does not depend on partitions, order or retries. Householder reflections bring it to
tridiagonal form; the leading eigenvalues come from bisection by Sturm counts; each one's eigenvector of
the tridiagonal matrix comes from inverse iteration, orthogonalised anew against the vectors of
its cluster of close eigenvalues, and is turned back by the reflections. Vectors are projected in tasks.

Memory. The driver holds the covariance alone, ``dimension**2`` numbers (at most ``MAX_DIMENSION`` dimensions); tasks hold a
batch and the same square. The projection that is sent to tasks has eight vectors.

Defined cases: rows whose vector is null or empty, or holds a null, NaN or infinite entry, are dropped; vectors of
different lengths are an error, as they have no covariance; so is a number ``x`` beyond 62 bits; a deviation is a whole
number of up to 38 digits (it grows with the square of the number of vectors); null and repeated ``vec_id``
and repeated rows are rows of their own; fewer than eight dimensions, or eigenvalues that are zero but for rounding
(all vectors equal, or on a plane), give fewer components, maybe none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.common import saved

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
MAX_DIMENSION = 4096

# ------------------------------------------------------------------------------------- eigenvectors


def tridiagonal(matrix: np.ndarray):
    """Diagonal, off-diagonal, and the unit vectors of the reflections that bring a symmetric matrix there."""
    a = matrix.copy()
    size = len(a)
    reflections = []
    for k in range(size - 2):
        column = a[k + 1:, k]
        length = np.sqrt(column @ column)
        u = np.zeros(size - k - 1)
        if length > 0 and np.any(column[1:]):
            u[:] = column
            u[0] += length if column[0] >= 0 else -length
            u /= np.sqrt(u @ u)
            # P B P with P = 1 - 2 u u', as a symmetric update of rank two.
            block = a[k + 1:, k + 1:]
            p = block @ u
            q = p - (u @ p) * u
            block -= 2 * (np.outer(u, q) + np.outer(q, u))
            a[k + 1:, k] -= 2 * u * (u @ column)
        reflections.append(u)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflections


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues lie below each of the numbers ``at``: the negative terms of the Sturm sequence."""
    squares = off ** 2
    term = diagonal[0] - at
    below = (term < 0).astype(int)
    for k in range(1, len(diagonal)):
        term = np.where(np.abs(term) < least, -least, term)
        term = diagonal[k] - at - squares[k - 1] / term
        below += term < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection of the Gershgorin interval to the last bit."""
    size = len(diagonal)
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low, high = np.full(wanted, (diagonal - reach).min()), np.full(wanted, (diagonal + reach).max())
    widest = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    least = np.finfo(float).eps ** 2 * widest
    high += 1e-15 * widest
    ranks = size - np.arange(wanted)  # this many eigenvalues lie below what is above the k-th largest
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        above = count_below(diagonal, off, middle, least) >= ranks
        high = np.where(above, middle, high)
        low = np.where(above, low, middle)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) x = right by elimination with exchange of rows; pivots of zero count as ``least``."""
    size = len(diagonal)
    main, above, second = diagonal - shift, np.zeros(size), np.zeros(size)
    above[:size - 1] = off
    x = right.copy()
    for k in range(size - 1):
        below = off[k]
        if abs(main[k]) < abs(below):
            main[k], below = below, main[k]
            above[k], main[k + 1] = main[k + 1], above[k]
            if k + 2 < size:
                second[k], above[k + 1] = above[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        elif abs(main[k]) < least:
            main[k] = least
        factor = below / main[k]
        main[k + 1] -= factor * above[k]
        above[k + 1] -= factor * second[k]
        x[k + 1] -= factor * x[k]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(size - 1, -1, -1):
        if k + 1 < size:
            x[k] -= above[k] * x[k + 1]
        if k + 2 < size:
            x[k] -= second[k] * x[k + 2]
        x[k] /= main[k]
        if abs(x[k]) > 1e200:
            x /= abs(x[k])
    return x / np.sqrt(x @ x)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector (row) for each of the falling eigenvalues, by inverse iteration."""
    size = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    least = eps * norm
    random = np.random.default_rng(12)
    vectors, cluster, last = np.zeros((len(values), size)), 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        # Equal eigenvalues get shifts of their own, so that their iterations differ.
        shift = value if last is None or last - value > 10 * least else last - 10 * least
        last = shift
        x = random.standard_normal(size)
        for _ in range(5):
            x = solve_shifted(diagonal, off, shift, x, least)
            for _ in range(2):
                close = vectors[cluster:k]
                x = x - close.T @ (close @ x)
                x /= np.sqrt(x @ x)
        vectors[k] = x
    return vectors


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    wanted, largest = min(wanted, len(matrix)), np.abs(matrix).max()
    if largest == 0:
        return np.zeros(wanted), np.eye(len(matrix))[:wanted]
    diagonal, off, reflections = tridiagonal(matrix / largest)
    values = leading_values(diagonal, off, wanted)
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        u = reflections[k]
        vectors[:, k + 1:] -= 2 * np.outer(vectors[:, k + 1:] @ u, u)
    return values * largest, vectors


# -------------------------------------------------------------------------------------------- jobs


def usable(rows: DataFrame, column: str) -> DataFrame:
    """``vec_id`` and ``c``: the vectors without missing or non-finite entries."""
    pairs = rows.select(F.col("vec_id"), F.col(column).cast("array<double>").alias("c"))
    return pairs.where("size(c) > 0 AND forall(c, e -> coalesce(abs(e) < double('infinity'), false))")


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """The numbers x, a row per vector."""
    lengths = pc.list_value_length(vectors).to_numpy()
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors of different lengths have no covariance")
    scaled = np.floor(SCALE * vectors.flatten().to_numpy())
    if len(scaled) and np.abs(scaled).max() >= 2.0 ** 62:
        raise OverflowError(f"an entry is beyond 64 bits: {np.abs(scaled).max()} in units of 1/{SCALE}")
    return (scaled.astype(np.int64) + SHIFT).reshape(len(vectors), -1)


def _exact_sum(x: np.ndarray) -> list[int]:
    largest = int(np.abs(x).max(initial=0))
    if largest * len(x) < 2 ** 62:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def exact_products(y: np.ndarray) -> list[np.ndarray]:
    """Matrices of whole numbers whose sum is y'y. Doubles hold products of rows exactly as long as their sum is below 2**53."""
    largest = int(np.abs(y).max(initial=0))
    if largest ** 2 >= 2 ** 52:
        wide = y.astype(object)
        return [wide.T @ wide]
    rows = max(1, 2 ** 52 // max(largest ** 2, 1))
    return [
        (part.T @ part).astype(np.int64)
        for part in (y[k:k + rows].astype(float) for k in range(0, len(y), rows))
    ]


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each dimension."""

    def add(batches):
        count, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch.column(0))
                if total is not None and len(total) != x.shape[1]:
                    raise ValueError("vectors of different lengths have no covariance")
                total = [a + b for a, b in zip(total or [0] * x.shape[1], _exact_sum(x))]
                count += batch.num_rows
        if count:
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(total)), pa.int32()), pa.array([str(s) for s in total]),
                pa.array([count] * len(total), pa.int64())], ["i", "s", "n"])

    parts = vectors.select("c").mapInArrow(add, "i int, s string, n long")
    found = parts.groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    if len({row["n"] for row in found}) > 1:
        raise ValueError("vectors of different lengths have no covariance")
    if len(found) > MAX_DIMENSION:
        raise ValueError(f"{len(found)} dimensions; the covariance is kept for {MAX_DIMENSION} at most")
    return (found[0]["n"] if found else 0), [int(row["s"]) for row in found]


def covariance(vectors: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance of all vectors, divisor n, each entry rounded once."""
    size = len(total)
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)

    def multiply(batches):
        held, wide = np.zeros((size, size), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in exact_products(whole_numbers(batch.column(0)) - centre):
                big = part.dtype == object or int(np.abs(part).max()) >= 2 ** 61
                if big or int(np.abs(held).max()) >= 2 ** 61:
                    wide = (0 if wide is None else wide) + held.astype(object) + part.astype(object)
                    held[:] = 0
                else:
                    held += part
        i, j = np.triu_indices(size)
        products = held[i, j] if wide is None else (wide + held)[i, j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(p) for p in products.tolist()])],
            ["i", "j", "p"])

    parts = vectors.select("c").mapInArrow(multiply, "i int, j int, p string")
    added = parts.groupBy("i", "j").agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("p"))
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    matrix = np.zeros((size, size))
    for i, j, p in added.toLocalIterator():
        matrix[i, j] = matrix[j, i] = (n * int(p) - rest[i] * rest[j]) / (n * n)
    return matrix


def projected(vectors: DataFrame, n: int, total: list[int], values: np.ndarray, components: np.ndarray) -> DataFrame:
    """``vec_id``, ``deviation`` and ``whitened`` (an array) of every vector."""
    centre = np.array([s // n for s in total], np.int64)
    parts = np.array([s - n * (s // n) for s in total], np.int64)  # S = n * centre + parts
    rest = sum(p * p for p in parts.tolist())
    turned = (components / np.sqrt(values)[:, None]).T

    def project(batches):
        for batch in batches:
            y = whole_numbers(batch.column(1)) - centre
            # x - S/n, and n*x - S = n*y - parts.
            white = (y - parts / n) @ turned
            largest = int(np.abs(y).max(initial=0)) + n
            exact = y if largest ** 2 * len(total) < 2 ** 62 else y.astype(object)
            deviations = [n * n * a - 2 * n * b + rest for a, b in zip(
                (exact ** 2).sum(1).tolist(), (exact @ parts).tolist())]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations, pa.decimal128(38)), lists], ["vec_id", "deviation", "white"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "c").mapInArrow(
        project, f"vec_id {kind}, deviation decimal(38,0), white array<double>")


def identity_error(white: DataFrame, size: int) -> float:
    """Largest absolute entry of the covariance of the arrays ``white`` minus the identity."""
    means = white.agg(*[F.avg(F.col("white")[k]) for k in range(size)]).first()
    centred = [F.col("white")[k] - F.lit(means[k]) for k in range(size)]
    found = white.agg(*[F.avg(centred[i] * centred[j]) for i in range(size) for j in range(i, size)]).first()
    wanted = [float(i == j) for i in range(size) for j in range(i, size)]
    return max(abs(a - b) for a, b in zip(found, wanted))


def whitened(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``."""
    spark, vectors = rows.sparkSession, usable(rows, column)
    n, total = sums(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    none = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                     "explained double, identity_error double")
    if n == 0:
        return none
    matrix = covariance(vectors, n, total)
    trace = float(np.trace(matrix))
    values, axes = leading(matrix, components)
    # Rounding alone makes eigenvalues of this size.
    real = values > 1e-13 * len(matrix) * trace
    values, axes = values[real], axes[real]
    if not len(values):
        return none
    white = saved(projected(vectors, n, total, values, axes), "whitened")
    error = identity_error(white, len(values))
    shares = ", ".join(f"{value / trace!r}D" for value in values.tolist())
    return white.selectExpr("vec_id", "deviation", "posexplode(white) AS (place, whitened)").selectExpr(
        "vec_id", "place + 1 AS component", f"{n}L AS n", "deviation", "whitened",
        f"array({shares})[place] AS explained", f"{error!r}D AS identity_error")
