"""Whitening against dense solvers: the small matrices, then whole tables."""

import numpy as np
import pytest

from posequarry.llm import queries, whitening
from tests.llm.test_operators import FOLDER


def matrices():
    draw = np.random.default_rng(0)
    yield from (np.linalg.qr(draw.normal(size=(900, d)), mode="r") for d in (1, 2, 3, 17, 64))
    yield np.eye(12)
    yield np.zeros((4, 4))
    yield np.diag([1.0, 1, 1, 2, 2, 0, 0])
    dependent = draw.normal(size=(300, 10))
    dependent[:, 3], dependent[:, 5] = dependent[:, 2], 0
    yield np.linalg.qr(dependent, mode="r")
    yield np.concatenate([np.linalg.qr(draw.normal(size=(4, 9)), mode="r"), np.zeros((5, 9))])
    yield np.linalg.qr(draw.normal(size=(300, 20)) * 10.0 ** -np.arange(20), mode="r")
    turn = [np.linalg.qr(draw.normal(size=(30, 30)))[0] for _ in range(2)]
    yield turn[0] * np.repeat([3.0, 2.0, 1.0], 10) @ turn[1]
    pairs = np.diag(np.abs(np.arange(21.0) - 10) + 12) + np.eye(21, k=1) + np.eye(21, k=-1)
    yield np.linalg.cholesky(pairs).T


@pytest.mark.parametrize("r", list(matrices()))
def test_singular_vectors(r):
    values, vectors = whitening.right_singular(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    size = max(want.max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(r))).max() < 1e-10
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() <= 1e-12 * size


def test_small_values_are_accurate():
    """The least singular value of a graded bidiagonal matrix, 22 orders down, to full relative accuracy."""
    a, b = 10.0 ** -np.arange(0.0, 23, 2), 0.5 * 10.0 ** -np.arange(1.0, 22, 2)
    values = whitening.squared_singular_values(a, b)
    # The product of all is the determinant, which the diagonal gives exactly.
    assert np.isclose(np.log(values).sum(), 2 * np.log(a).sum(), rtol=1e-14)


def dense(x, k):
    """deviation, |projection| and explained of each row by an eigenvalue solver."""
    n, exact = len(x), [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*exact)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in exact]
    y = x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return deviation, np.abs(y @ v[:, :k]) / np.sqrt(np.maximum(e[:k], 1e-300)), e[:k] / e.sum()


def check(rows, ids, x, k):
    n, d = x.shape
    k = min(k, d)
    deviation, white, share = dense(x, k)
    place = {v: i for i, v in enumerate(ids)}
    assert len(rows) == n * k
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert np.isclose(r["explained"], share[c], rtol=1e-10)
        assert abs(abs(r["whitened"]) - white[i, c]) < 1e-6
        assert r["identity_error"] < 1e-10


def test_given_vectors(spark):
    rows = queries.op11_whitening(spark, FOLDER).collect()
    given = [r for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    x = np.floor(64 * np.array([r["embedding"] for r in given])) + 1_000_000
    check(rows, [r["vec_id"] for r in given], x, 32)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 3)
    draw = np.random.default_rng(2)
    good = [(k, [float(v) for v in draw.normal(size=4)]) for k in range(40)]
    good += [(100 + k, good[k][1]) for k in range(3)] + [(200, [0.0] * 4)]
    nan, inf = float("nan"), float("inf")
    bad = [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [nan, 1.0, 1.0, 1.0]), (303, [1.0, -inf, 1.0, 1.0]), (304, []), (305, [1.0])]
    schema = "vec_id long, embedding array<float>, n string, x int"
    table = spark.createDataFrame([(*r, "other", None) for r in good + bad], schema).repartition(7)
    x = np.floor(64 * np.array([r[1] for r in good], np.float32).astype(float)) + 1_000_000
    rows = whitening.whiten(table, 32).collect()
    check(rows, [r[0] for r in good], x, 4)
    signs = {}
    for r in rows:  # the sign is the same for all rows
        signs.setdefault(r["component"], []).append(r["whitened"])
    assert all(abs(sum(v)) < 1e-6 for v in signs.values())
    assert whitening.whiten(table.filter("vec_id >= 300 and vec_id < 305")).count() == 0
    assert whitening.whiten(table.limit(0)).count() == 0
    # One row has no spread at all; a constant entry and equal entries leave directions without any.
    (one,) = {(r["whitened"], r["explained"], r["identity_error"]) for r in whitening.whiten(table.filter("vec_id = 1")).collect()}
    assert one == (None, None, None)
    flat = spark.createDataFrame([(k, [float(k), float(k), 3.0]) for k in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(flat).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1}
    assert all(r["identity_error"] < 1e-10 for r in got) and len(got) == 27
    null = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 5.0])], "vec_id long, embedding array<double>"))
    assert null.count() == 4 and null.filter("vec_id is null").count() == 4
