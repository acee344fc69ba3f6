"""Whitening against the eigenvectors of the covariance matrix."""

import numpy as np
import pytest

from lotline.llm import queries, whitening
from tests.conftest import SMALL_TABLES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, most=16):
    """``{(id, component): ...}`` for ``(id, vector)``, signs free; by numpy's solver."""
    x = np.array([np.floor(np.array(v, np.float64) * 64).astype(np.int64) + 1_000_000 for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[: min(most, int((values > values.max() * 1e-18).sum()))]
    values, vectors = values[order], vectors[:, order]
    white = (x - sums / n) @ vectors / np.sqrt(values)
    apart = [sum((n * a - s) ** 2 for a, s in zip(r, sums.tolist(), strict=True)) for r in x.tolist()]
    return n, white, values / np.trace(centred.T @ centred / n), apart


def check(got, rows):
    n, white, explained, apart = brute(rows)
    count = len(explained)
    assert len(got) == len(rows) * count
    ids = [i for i, _ in rows]
    table = {(r.vec_id, r.component): r for r in got}
    found = np.array([[table[i, k + 1].whitened for k in range(count)] for i in ids])
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < 1e-8
    for i, dev in zip(ids, apart, strict=True):
        for k in range(count):
            r = table[i, k + 1]
            assert r.n == n and r.deviation == dev and abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(3, 0.2, d) + rng.standard_normal(d)
    return x.astype(np.float32)


def test_query(spark):
    got = queries.QUERIES["op12_whitening"](spark, SMALL_TABLES).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL_TABLES}/embeddings.parquet").collect()]
    check(got, rows)


def test_copies_count_once_and_odd_rows_drop_out(spark):
    x = vectors(1, 60, 6).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(100 + i, x[0]) for i in range(40)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (205, [1.0, 2.0]), (206, [1e30] * 6)]
    table = spark.createDataFrame([(i, v, None) for i, v in rows + odd], SCHEMA)
    table = table.selectExpr("*", "'odd' AS x", "1 AS n", "2 AS i", "3 AS value", "4 AS component", "5 AS vector").repartition(5)
    check(whitening.whiten(table).collect(), rows)


def test_equal_deviations_and_directions_without_any(spark):
    """Rows that vary alike along two axes, less along one, and not along the fourth."""
    rows = [(i, [float(s == k) * size * sign for k in range(4)]) for i, (s, sign, size) in enumerate([(0, 1, 2), (0, -1, 2), (1, 1, 2), (1, -1, 2), (2, 1, 1), (2, -1, 1)])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 18
    assert max(r.identity_error for r in got) < 1e-12
    by = {(r.vec_id, r.component): r for r in got}
    assert by[0, 1].explained == pytest.approx(by[0, 2].explained) and by[0, 1].explained == pytest.approx(4 * by[0, 3].explained)
    white = np.array([[by[i, k].whitened for k in (1, 2, 3)] for i in range(6)])
    assert np.abs(white.T @ white / 6 - np.eye(3)).max() < 1e-12


def test_tables_that_do_not_vary(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], SCHEMA)
    for table in (one, one.limit(0), spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)):
        got = whitening.whiten(table)
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_and_repeated_ids(spark):
    x = vectors(2, 12, 3).tolist()
    rows = [(None, x[0]), (5, x[1]), (5, x[2])] + [(10 + i, v) for i, v in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert len(got) == 3 * len(rows) and sum(r.vec_id is None for r in got) == 3 and {r.n for r in got} == {12}


def test_steps_of_a_wide_matrix():
    """The largest components come out of fewer steps than dimensions."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 80)) * np.concatenate([[60, 40, 25], np.full(77, 1.0)])
    x -= x.mean(axis=0)

    def product(left, p):
        w = x @ p
        return x.T @ w, (x @ left).T @ w, float(w @ w)

    right, small = whitening.bidiagonalise(product, 80, np.linalg.norm(x), 20)
    _, values, turn = np.linalg.svd(small)
    exact_values, exact = np.linalg.svd(x, full_matrices=False)[1:]
    assert np.abs(values[:3] / exact_values[:3] - 1).max() < 1e-12
    assert np.abs(np.abs((right @ turn[:3].T).T @ exact[:3].T) - np.eye(3)).max() < 1e-9
    right, small = whitening.bidiagonalise(product, 80, np.linalg.norm(x))
    assert np.abs(np.linalg.svd(small)[1] / exact_values - 1).max() < 1e-11 and np.abs(right.T @ right - np.eye(80)).max() < 1e-13


def test_deviations_beyond_64_bits():
    found = whitening.Whitening(10**9, (5, 7), np.zeros((2, 0)), np.zeros(0), 0.0)
    assert found.deviations(np.array([[10**4, 3], [0, 1]])) == [None, 25 + (10**9 - 7) ** 2]
    assert found.deviations(np.array([[3, 0]])) == [(3 * 10**9 - 5) ** 2 + 49]
