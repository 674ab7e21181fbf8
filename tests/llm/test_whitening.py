import math

import numpy as np
import pytest

from tallymast.llm import queries, whitening

from .conftest import FOLDER


def matrices():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 64, 150):
        b = rnd.standard_normal((n, n))
        yield b @ b.T
    yield np.eye(20)
    yield np.diag([5.0, 5, 5, 1, 1, 1, 1, 1, 1, 1])
    yield np.kron(np.eye(4), np.array([[2.0, 1], [1, 2]]))
    b = rnd.standard_normal((30, 3))
    yield b @ b.T
    q = np.linalg.qr(rnd.standard_normal((40, 40)))[0]
    yield q @ np.diag([3.0] * 5 + [2.999999] * 5 + [1.0] * 30) @ q.T


@pytest.mark.parametrize("matrix", list(matrices()))
def test_eigenvectors_of_clusters_and_blocks(matrix):
    values, vectors = whitening.leading_eigen(matrix, 8)
    size = np.abs(matrix).max()
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:8], atol=1e-12 * size * len(matrix))
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12 * size * len(matrix)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12


def test_sturm_counts():
    rnd = np.random.default_rng(4)
    diagonal, off = rnd.standard_normal(30), rnd.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 41)
    assert whitening.above(diagonal, off, at).tolist() == [(values > x).sum() for x in at]


def test_query_against_numpy(spark):
    df = queries.QUERIES["op12_whitening"](spark, FOLDER)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    x = np.floor(1024 * np.array(list(vectors.values()), np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    covariance = np.cov(x.T, bias=True)
    values, vecs = np.linalg.eigh(covariance)
    values, vecs = values[::-1][:8], vecs[:, ::-1][:, :8]
    white = (x - sums / n) @ vecs / np.sqrt(values)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    rows = df.collect()
    assert len(rows) == 8 * n
    at = {v: k for k, v in enumerate(vectors)}
    signs = {}
    for r in rows:
        k, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[k]
        assert math.isclose(r["explained"], values[c] / np.trace(covariance), rel_tol=1e-9)
        assert math.isclose(abs(r["whitened"]), abs(white[k, c]), rel_tol=1e-6, abs_tol=1e-7)
        if abs(white[k, c]) > 0.1:
            signs.setdefault(c, set()).add(np.sign(r["whitened"] * white[k, c]))
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_odd_rows_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, n string, component string"
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k), float(k * k % 7), 1.0], "x", "x") for k in range(12)]
    bad = [(20, None, "x", "x"), (21, [1.0, None, 1.0], "x", "x"), (22, [nan, 1.0, 1.0], "x", "x"), (23, [inf, 1.0, 1.0], "x", "x"), (24, [1.0], "x", "x"), (25, [], "x", "x")]
    df = spark.createDataFrame(good + bad + [good[3], (None, [5.0, 5.0, 1.0], "x", "x")], schema)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 14 * 3 and {r["n"] for r in rows} == {14}
    assert {r["vec_id"] for r in rows} == {*range(12), None}
    # the third dimension does not vary, so the last component has no variance
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in rows)
    assert all(r["identity_error"] < 1e-9 for r in rows)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id > 19")).where("vec_id < 24").count() == 0
    same = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in whitening.whiten(same).collect()] == [(0, None, None, None)] * 4


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(df).collect()} == {None}
    model = whitening.Whitening(3, [7, 9], 1.0, np.ones(1), np.ones((1, 2)))
    x = np.array([[2**31, -5], [1, 2]])
    assert model.deviation(x) == [None if (v := sum((3 * int(a) - s) ** 2 for a, s in zip(row, (7, 9)))) >= 2**63 else v for row in x]
    x = np.array([[900_000_000, 1]])
    assert model.deviation(x) == [(3 * 900_000_000 - 7) ** 2 + 36]
