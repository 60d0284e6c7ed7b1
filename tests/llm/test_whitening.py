"""Whitening against numpy's eigenvalues, and the qd solver against numpy's singular values."""

import numpy as np
import pytest

from passforge.llm import bidiagonal as bd
from passforge.llm import queries, whitening


def spread(singular, seed=3):
    rng = np.random.default_rng(seed)
    n = len(singular)
    q, p = (np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(2))
    return np.linalg.qr(q @ np.diag(singular) @ p, mode="r")


def cases():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 16, 64):
        yield np.triu(rng.normal(size=(n, n)))
    yield np.diag(rng.normal(size=30))
    yield np.eye(20)
    yield np.zeros((8, 8))
    yield spread([5.0] * 10 + [1.0] * 20 + [1e-3] * 34)
    yield spread(1 + 1e-10 * np.arange(64))
    yield spread(10.0 ** -np.arange(64))
    yield spread([3.0, 2.0, 1.0] + [0.0] * 61)
    yield np.linalg.qr(rng.normal(size=(50_000, 64)), mode="r")
    for _ in range(200):  # zero pivots, equal and zero values
        n = rng.integers(1, 12)
        yield np.triu(rng.integers(-2, 3, (n, n))).astype(float)


def test_right_singular_equals_numpy():
    for a in cases():
        most = min(16, len(a))
        values, vectors = bd.right_singular(a, most)
        want = np.linalg.svd(a, compute_uv=False)
        size = max(want[0], 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(most)).max() < 1e-13
        assert np.abs(a.T @ (a @ vectors) - vectors * values[:most] ** 2).max() <= 1e-13 * size**2


def test_dqds_is_relatively_accurate():
    diagonal = 10.0 ** -np.arange(12)
    above = diagonal[:-1] / 2
    values = bd.dqds(diagonal, above)
    again = bd.dqds(diagonal * 2.0**-300, above * 2.0**-300)
    assert np.allclose(values, again * 2.0**300, rtol=1e-14, atol=0)
    assert np.prod(values) == pytest.approx(np.prod(diagonal), rel=1e-12, abs=0)  # the determinant


def test_bidiagonal_form():
    a = np.triu(np.random.default_rng(1).normal(size=(20, 20)))
    diagonal, above, right = bd.bidiagonalise(a)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.abs(right.T @ right - np.eye(20)).max() < 1e-13
    assert np.abs(right @ (b.T @ b) @ right.T - a.T @ a).max() < 1e-12


def table(spark, seed=5, n=120, dim=20):
    rng = np.random.default_rng(seed)
    data = (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.3).astype(np.float32)
    data[30:70] = data[2]
    rows = [(i, v.tolist(), "w") for i, v in enumerate(data)] + [(3, data[3].tolist(), "w")]
    rows += [(None, data[4].tolist(), None), (None, None, None), (900, [float("nan")] * dim, "w"), (901, [None] + [1.0] * (dim - 1), "w"),
             (902, [float("-inf")] + [0.0] * (dim - 1), "w"), (903, [], "w"), (904, [1.0] * (dim + 1), "w")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(4), rows


def check(got, rows, most=16, rel=1e-8):
    """Rows of whiten() against the definition."""
    dim = len(rows[0][1])
    kept = [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and np.isfinite(x) for x in r[1])]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (n * fit - sums) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(most, dim)
    want = ((n * x - sums) / n @ w[:, :k]) / np.sqrt(e[:k])
    deviation = ((n * x - sums) ** 2).sum(1)
    assert len(got) == len(kept) * k
    by_component = {}
    for r in got:
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, k + 1))
    for j, own in by_component.items():
        own.sort(key=lambda r: (r.vec_id is not None, r.vec_id, r.deviation, abs(r.whitened)))
        order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is not None, kept[i][0], deviation[i], abs(want[i, j - 1])))
        z, y = np.array([r.whitened for r in own]), want[order, j - 1]
        assert min(np.abs(z - y).max(), np.abs(z + y).max()) < rel * max(1, np.abs(y).max())
        assert [r.deviation for r in own] == deviation[order].tolist()
        assert {r.n for r in own} == {n}
        assert own[0].explained == pytest.approx(e[j - 1] / e.sum(), rel=1e-9)
        assert own[0].identity_error < 1e-9


def test_whiten_equals_definition(spark, monkeypatch):
    df, rows = table(spark)
    check(whitening.whiten(df).collect(), rows)
    monkeypatch.setattr(whitening, "GROUP", 2)  # several rounds of groups
    check(whitening.whiten(df).collect(), rows)
    check(whitening.whiten(df, most=3).collect(), rows, most=3)


def test_few_directions_and_no_rows(spark):
    line = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(30)]
    df = spark.createDataFrame(line, "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    assert len(rows) == 30 and {r.component for r in rows} == {1} and rows[0].n == 7
    assert rows[0].explained == pytest.approx(1.0)
    assert whitening.whiten(df.filter("vec_id % 7 = 0")).collect() == []  # one distinct vector
    assert whitening.whiten(df.filter("false")).collect() == []


def test_large_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    assert len(rows) == 6 and all(np.isfinite(r.whitened) for r in rows)
    gaps = whitening.deviations(np.array([[2**30, 0]]), 10, [0, 0])
    assert gaps == [None]


def test_query_equals_definition(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(queries.queries()["op11_whitening"](spark, d).collect(), rows)
