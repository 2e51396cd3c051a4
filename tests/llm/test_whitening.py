"""Operator 12 against NumPy's eigenvectors, and its defined cases."""

import math

import numpy as np
import pytest

from crmkiln.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component int"


def table_of(spark, vectors, schema=SCHEMA):
    rows = [(k, None if v is None else [None if e is None else float(e) for e in v], -1, -2) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, schema).repartition(3)


def expected(vectors, wanted=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int) + 100_000
    y = x - x.mean(0)
    values, axes = np.linalg.eigh(y.T @ y / len(x))
    values, axes = values[::-1][:wanted], axes.T[::-1][:wanted]
    deviations = [sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0))) for row in x]
    return deviations, (y @ axes.T) / np.sqrt(values), values / np.trace(y.T @ y / len(x))


def compare(rows, vectors, wanted=8):
    deviations, white, explained = expected(vectors, wanted)
    assert len(rows) == len(vectors) * white.shape[1]
    got = np.empty(white.shape)
    for row in rows:
        k = row.component - 1
        got[row.vec_id, k] = row.whitened
        assert (row.n, row.deviation) == (len(vectors), deviations[row.vec_id])
        assert row.explained == pytest.approx(explained[k], rel=1e-9)
        assert row.identity_error < 1e-10
    for k in range(white.shape[1]):
        sign = 1 if got[:, k] @ white[:, k] > 0 else -1
        assert np.abs(got[:, k] - sign * white[:, k]).max() < 1e-7


@pytest.mark.parametrize("size, kind", [(24, "spread"), (8, "spread"), (3, "spread"), (1, "spread"), (12, "far")])
def test_whitened_vectors(spark, size, kind):
    rng = np.random.default_rng(size)
    vectors = rng.normal(size=(60, size)) * np.linspace(0.5, 3, size)
    if kind == "far":
        vectors += 3000  # a mean much larger than the spread
    compare(whitening.whitened(table_of(spark, vectors)).collect(), vectors, min(8, size))


@pytest.mark.parametrize("values", [
    [9, 4, 1, 0.25, 0.1], [5, 5, 5, 2, 2, 1, 1, 1, 1], [1, 1 - 1e-13, 1 - 2e-13, 0.5, 0.5], [0, 0, 0], [7], [2, -3, 1e-9],
    list(np.linspace(1, 2, 40)), [1] * 30 + [1.0001] * 30,
])
def test_eigenvectors(values):
    values = np.array(values, float)
    q, _ = np.linalg.qr(np.random.default_rng(len(values)).normal(size=(len(values), len(values))))
    for basis in (q, np.eye(len(values))):
        matrix = (basis * values) @ basis.T
        matrix = (matrix + matrix.T) / 2
        got, vectors = whitening.leading(matrix, 8)
        assert np.allclose(got, np.sort(values)[::-1][:8], atol=1e-12 * max(1, np.abs(values).max()))
        assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-11)
        assert np.abs(matrix @ vectors.T - vectors.T * got).max() < 1e-11 * max(1, np.abs(values).max())


def test_sturm_counts():
    rng = np.random.default_rng(1)
    diagonal, off = rng.normal(size=20), rng.normal(size=19)
    off[7] = 0
    matrix = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    values = np.linalg.eigvalsh(matrix)
    at = np.linspace(-5, 5, 200)
    assert (whitening.count_below(diagonal, off, at, 1e-300) == (values[None] < at[:, None]).sum(1)).all()


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for largest in (3, 1 << 20, 1 << 25, 1 << 40):
        y = rng.integers(-largest, largest, (50, 4))
        want = y.astype(object).T @ y.astype(object)
        assert (sum(part.astype(object) for part in whitening.exact_products(y)) == want).all()


def test_partitions_do_not_matter(spark):
    vectors = np.random.default_rng(3).normal(size=(200, 10))
    frames = [table_of(spark, vectors).repartition(k) for k in (1, 7)]
    one, two = (sorted(whitening.whitened(frame).collect()) for frame in frames)
    assert [row[:6] for row in one] == [row[:6] for row in two]


def test_dropped_and_repeated_rows(spark):
    good = np.random.default_rng(4).normal(size=(20, 3)).round(2).tolist()
    odd = [None, [], [1.0, None, 2.0], [math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0]]
    rows = [(k, v, 0, 0) for k, v in enumerate(good)] + [(None, good[0], 0, 0), (3, good[3], 0, 0), (3, good[3], 0, 0)]
    rows += [(100 + k, v, 0, 0) for k, v in enumerate(odd)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert len(got) == 23 * 3 and {row.n for row in got} == {23} and not {row.vec_id for row in got} & set(range(100, 105))
    assert len({row.whitened for row in got if row.vec_id == 3 and row.component == 1}) == 1


def test_few_or_equal_vectors(spark):
    assert whitening.whitened(table_of(spark, [])).count() == 0
    assert whitening.whitened(table_of(spark, [[1, 2]])).count() == 0
    assert whitening.whitened(table_of(spark, [[1, 2]] * 5)).count() == 0
    # On a line there is one component.
    line = whitening.whitened(table_of(spark, [[k, 2 * k, 0] for k in range(5)])).collect()
    assert {row.component for row in line} == {1} and len(line) == 5
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(table_of(spark, [[1, 2], [1, 2, 3]])).collect()


def test_large_numbers(spark):
    vectors = [[k * 1e9, (k % 3) * 1e7] for k in range(9)]
    schema = SCHEMA.replace("float", "double")
    rows = whitening.whitened(table_of(spark, vectors, schema)).collect()
    x = [[math.floor(1024 * e) + 100_000 for e in v] for v in vectors]
    sums = [sum(column) for column in zip(*x)]
    want = {k: sum((9 * a - s) ** 2 for a, s in zip(row, sums)) for k, row in enumerate(x)}
    assert {row.vec_id: int(row.deviation) for row in rows} == want and max(want.values()) > 2 ** 63
