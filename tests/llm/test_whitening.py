"""Whitening against numpy's own eigenvectors, and the result's definition on all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labourlens.llm import queries, whitening


def rows_of(spark, tmp_path, vectors):
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op12_embedding_whitening(spark, str(tmp_path)).collect()


def check(got, vectors, width):
    """All of the contract, from the definition."""
    def usable(v):
        return v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v)
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for i, v in enumerate(vectors) if usable(v)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(4, int((values > cov.trace() * 1e-12).sum()))
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in sorted(x) for c in range(1, k + 1)]
    signs = {}
    for r in got:
        v, c = x[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
        want = float((np.array(v) - np.array([s / n for s in sums])) @ basis[:, c]) / math.sqrt(values[c])
        if abs(want) > 1e-6:
            assert signs.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(r.whitened) - abs(want)) < 1e-7 and math.isclose(r.explained, values[c] / cov.trace(), rel_tol=1e-9) and r.identity_error < 1e-9
    return k


def test_leading_equals_numpy():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 5, 40):
        a = rng.standard_normal((size, size))
        a = a @ a.T
        values, vectors = whitening.leading(a, 4)
        want, _ = np.linalg.eigh(a)
        k = min(4, size)
        assert np.allclose(values, want[::-1][:k], rtol=1e-12) and np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * want.max()
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-13


@pytest.mark.parametrize("a", [np.eye(6), np.diag([3.0, 3, 3, 1, 1, 0]), np.ones((5, 5)), np.diag([2.0, 2 - 1e-13, 2 - 2e-13, 1, 1]),
                               np.kron(np.eye(3), [[2.0, 1], [1, 2]]), np.zeros((3, 3)), np.array([[1e-200, 0], [0, 1e-201]])])
def test_close_and_equal_eigenvalues(a):
    values, vectors = whitening.leading(a, 4)
    k, scale = len(values), max(np.abs(a).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-13 * scale)
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-12 * scale and np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(8)
    d, e = rng.standard_normal(9), rng.standard_normal(8)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    for x in np.linspace(-4, 4, 41):
        assert whitening.below(d, e, x, 1e-300) == (values < x).sum()


def test_whole_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)).tolist()
    vectors += [vectors[0]] * 150 + [[v + 1e-7 for v in vectors[1]]]  # a third are copies, which count once
    vectors += [None, [None] * 12, [1.0, float("nan")] + [0.0] * 10, [float("inf")] * 12, [float("-inf")] + [0.0] * 11, [1.0] * 5, [], [-0.001] * 12]
    assert check(rows_of(spark, tmp_path, vectors), vectors, 12) == 4


def test_large_entries_are_exact(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((40, 3)) * 3e4).tolist()
    got = rows_of(spark, tmp_path, vectors)
    assert max(r.deviation for r in got) > 2**55 and check(got, vectors, 3) == 3
    x = np.array([[2**39 + 1, -(2**39)], [5, 7]])
    assert (whitening.outer_sums(x) == x.astype(object).T @ x.astype(object)).all()
    m = whitening.Model(10**9, (10**20, -3), np.zeros(0), np.zeros((0, 2)), 0.0)
    assert [int(v) for v in whitening.deviations(np.array([[2**39, 1]]), m) if v is not None] == []
    assert int(whitening.deviations(np.array([[3, 1]]), whitening.Model(10, (7, -3), np.zeros(0), np.zeros((0, 2)), 0.0))[0]) == 23**2 + 13**2


def test_few_dependent_or_no_vectors(spark, tmp_path):
    assert rows_of(spark, tmp_path / "none", []) == []
    assert rows_of(spark, tmp_path / "one", [[1.0, 2.0]] * 5) == []
    assert rows_of(spark, tmp_path / "empty", [[], [], None]) == []
    line = [[float(i), 2.0 * i, 1.0] for i in range(9)]
    assert check(rows_of(spark, tmp_path / "line", line), line, 3) == 1


def test_clashing_columns_and_partitions(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), "a", "b") for i in range(50)], "vec_id long, embedding array<double>, x string, n string").withColumn("row", F.lit(1))
    a, b = (whitening.whiten(df.repartition(k)).orderBy("vec_id", "component") for k in (2, 7))
    assert a.columns == ["vec_id", "x", "row", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert a.drop("identity_error").collect() == b.drop("identity_error").collect()
