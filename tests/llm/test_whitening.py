"""Whitening against the eigenvectors of the covariance, in exact whole numbers where those are asked for."""

from decimal import Decimal

import numpy as np
import pytest

from flowlark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, x int, n int"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "c", 1, 2) for i, v in enumerate(vectors, first)], SCHEMA).repartition(3)


def check(rows, vectors, wanted=8):
    """Compares up to the sign of each component; returns the number of components."""
    x = np.floor(1024 * np.array(vectors)).astype(int) + 100000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(wanted, int((e > 1e-12 * e[0]).sum()))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == n * k
    want = centred @ q[:, :k] / np.sqrt(e[:k])
    mine = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in range(n)])
    gap = np.abs(np.diff(e[: k + 1])).min() / e[0] if k < len(e) else np.abs(np.diff(e[:k]), ).min(initial=e[0]) / e[0]
    if gap > 1e-6:
        assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-9 * max(1, 1e-3 / gap)
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)
    for (i, c), r in got.items():
        assert r.n == n and r.deviation == Decimal(int(deviation[i])) and abs(r.explained - e[c - 1] / e.sum()) <= 1e-10
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-9
    return k


def test_unlike_deviations(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 20)) * np.geomspace(10, 0.01, 20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0] + 3
    bad = frame(spark, [None, [None] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [-float("inf")] * 20], 1000)
    assert check(whitening.whiten(frame(spark, vectors).unionAll(bad)).collect(), vectors) == 8


def test_alike_deviations_and_large_offsets(spark):
    vectors = np.random.default_rng(1).normal(size=(500, 33)) + 1e6
    assert check(whitening.whiten(frame(spark, vectors)).collect(), vectors) == 8


def test_equal_deviations(spark):
    """Each of ten directions has the same deviation: any eight that whiten will do."""
    vectors = np.concatenate([np.eye(10), -np.eye(10)])
    assert check(whitening.whiten(frame(spark, vectors)).collect(), vectors) == 8


@pytest.mark.parametrize("rank", [1, 3, 9])
def test_few_directions(spark, rank):
    rng = np.random.default_rng(rank)
    vectors = np.repeat(rng.integers(-4, 5, (60, rank)) @ rng.integers(-3, 4, (rank, 12)), 2, 0) + 0.0
    assert check(whitening.whiten(frame(spark, vectors)).collect(), vectors) == min(8, rank)


def test_fewer_rows_than_entries_and_short_vectors(spark):
    for size in ((5, 30), (50, 2), (40, 1)):
        vectors = np.random.default_rng(4).normal(size=size)
        assert check(whitening.whiten(frame(spark, vectors)).collect(), vectors) == min(8, size[0] - 1, size[1])


def test_nothing_to_whiten(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[0.0, 0.0]] * 4, [[]] * 3):
        assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_each_length_on_its_own(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(30, 5))
    rows = whitening.whiten(frame(spark, list(a)).unionAll(frame(spark, list(b), 40))).collect()
    assert check([r for r in rows if r.vec_id < 40], a) == 3
    shifted = whitening.whiten(frame(spark, list(b))).collect()
    assert sorted((r.vec_id - 40, r.component, abs(round(r.whitened, 9))) for r in rows if r.vec_id >= 40) == sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in shifted)


def test_numbers_beyond_64_bits(spark):
    vectors = [[1e300, 0.0], [-1e300, 1.0], [5e11, 2.0], [0.0, 3.0]]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    far = 1 << 52
    x = np.array([[far, 0], [-far, 1024], [far, 2048], [0, 3072]], object) + 100000
    x[2][0] = int(5e11 * 1024) + 100000
    want = ((4 * x - x.sum(0)) ** 2).sum(1)
    assert {r.vec_id: int(r.deviation) for r in rows} == dict(enumerate(want))


def test_single_columns_give_the_same(spark):
    """The width of the blocks is only how many products share a pass."""
    vectors = np.random.default_rng(6).normal(size=(80, 6)) * [9, 7, 5, 3, 2, 1]
    rows = whitening.whole_numbers(frame(spark, vectors))
    start = whitening.fit(rows, 6, 80)
    for width in (1, 2, 4):
        s, v = whitening.bidiagonal(rows, start, 6, width)
        assert np.allclose(s**2 / 80, start.eigenvalues, rtol=1e-12)
        assert np.allclose(np.abs((v * start.components).sum(0)), 1, atol=1e-12)
