"""Whitening against numpy's eigenvectors, exact integers, and the identity."""

import math

import numpy as np
import pytest

from pelagia.llm import whitening
from pelagia.llm.queries import op13_embedding_whitening
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, v in enumerate(vectors)], SCHEMA)


def expected(vectors, k):
    """x, deviations as Python integers, falling eigenvalues and whitened vectors by numpy."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    keep = [i for i in np.argsort(values)[::-1] if values[i] > 1e-9][:k]
    return deviation, values[keep], centred @ vectors_[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


@pytest.mark.parametrize("rows, width, k", [(60, 5, 3), (300, 12, 32), (4, 9, 32)])
def test_whitened_vectors(spark, rows, width, k):
    random = np.random.default_rng(rows)
    good = (random.standard_normal((rows, width)) * np.linspace(0.2, 3, width)).astype(np.float32).tolist()
    bad = [None, [None] * width, [math.nan] + [0.0] * (width - 1), [math.inf] * width, [1.0] * (width - 1) + [-math.inf]]
    found = whitening.whiten(table(spark, good + bad), components=k).collect()
    deviation, values, whitened, explained = expected(good, k)
    rank = len(values)
    assert rank == min(k, width, rows - 1) and len(found) == rows * rank
    got = np.zeros((rows, rank))
    for r in found:
        assert (r.n, r.deviation) == (rows, deviation[r.vec_id])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        got[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * signs).max() < 1e-6


def test_equal_eigenvalues_give_orthonormal_components(spark):
    """Vertices of a cross: all eigenvalues are equal, so any basis will do."""
    vectors = [[float(s * (i == j)) for j in range(6)] for i in range(6) for s in (1, -1)] * 3
    found = whitening.whiten(table(spark, vectors), components=4).collect()
    assert {r.component for r in found} == {1, 2, 3, 4}
    assert all(r.identity_error < 1e-9 and r.explained == pytest.approx(1 / 6) for r in found)


def test_tables_without_spread(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 7, [None, None], [[], []]):
        assert whitening.whiten(table(spark, vectors)).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(table(spark, [[1.0, 2.0], [1.0]])).collect()


def test_large_and_uneven_entries_stay_exact(spark):
    """Scatter entries beyond 64 bits, and dimensions a million times apart."""
    random = np.random.default_rng(9)
    vectors = (random.standard_normal((50, 4)) * [1e9, 1e3, 1.0, 0.1]).astype(np.float32).tolist()
    frame = table(spark, vectors)
    n, sums = whitening.exact_sums(frame, "embedding")
    matrix = whitening.exact_scatter(frame, "embedding", n, sums)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    wanted = [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(4)] for i in range(4)]
    assert matrix.tolist() == wanted and max(map(max, wanted)) > 2**70
    model = whitening.fit(frame, "embedding")
    assert whitening.identity_error(frame, "embedding", model) < 1e-6
    polynomial = whitening.characteristic_polynomial(frame, matrix)
    trace = sum(wanted[i][i] for i in range(4))
    assert polynomial[4] == 1 and -polynomial[3] == trace and polynomial[0] == round_det(wanted)


def round_det(matrix):
    """The determinant by expansion, in integers."""
    if len(matrix) == 1:
        return matrix[0][0]
    return sum((-1) ** j * matrix[0][j] * round_det([row[:j] + row[j + 1:] for row in matrix[1:]]) for j in range(len(matrix)))


def test_roots_are_counted_and_isolated():
    roots = [1, 3, 3, 3, 10**6, 10**6 + 1, 0, 0]
    polynomial = [1]
    for r in roots:
        polynomial = [a - r * b for a, b in zip([0, *polynomial], [*polynomial, 0])]
    for c in (0, 1, 2, 3, 4, 10**6 - 1, 10**6, 10**6 + 1):
        assert whitening.roots_above(polynomial, c) == sum(r > c for r in roots)
    bits, found = whitening.greatest_roots(polynomial, 8, sum(roots))
    assert [(round(r / 2**bits, 12), m) for r, m in found] == [(10**6 + 1, 1), (10**6, 1), (3, 3), (1, 1)]
    assert [m for _, m in whitening.greatest_roots(polynomial, 3, sum(roots))[1]] == [1, 1, 3]


@pytest.mark.parametrize("width", [1, 2, 3, 7])
def test_polynomials_modulo_a_prime(width):
    random = np.random.default_rng(width)
    for trial in range(20):
        matrix = random.integers(0, 3 if trial % 2 else 1000, (width, width))
        p = 10_007
        found = whitening.polynomial_modulo(matrix % p, p)
        for x in range(5):
            shifted = [[int(x * (i == j)) - int(matrix[i, j]) for j in range(width)] for i in range(width)]
            assert sum(int(c) * x**k for k, c in enumerate(found)) % p == round_det(shifted) % p


def test_query_on_the_given_table(spark):
    found = op13_embedding_whitening(spark, SMALL).toPandas()
    vectors = [r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()]
    deviation, values, whitened, explained = expected(vectors, 32)
    assert len(found) == 32 * len(vectors) and found.identity_error.max() < 1e-9
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((wide * whitened).sum(axis=0))
    assert np.abs(wide - whitened * signs).max() < 1e-6
    assert found.groupby("vec_id").deviation.first().tolist() == deviation
    assert np.allclose(found.groupby("component").explained.first(), explained, rtol=1e-9)
