"""Whitening against dense eigenvectors in numpy and exact whole numbers in Python."""

import math

import numpy as np
import pytest

from mailward.llm import whitening
from mailward.llm.whitening import Center, leading, whitened

SF = "/root/testdata/sf0.001"


def expected(vectors, components=32):
    """n, deviations, whitened up to sign, explained of rows that take part, by the definition."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    scaled = n * x - s
    c = (scaled / n).astype(float)
    values, turns = np.linalg.eigh(c.T @ c / n)
    values, turns = values[::-1], turns[:, ::-1]
    k = min(components, int((values > 1e-13 * values.sum()).sum()))
    return n, (scaled**2).sum(1).tolist(), c @ turns[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(rows, ids, vectors, tolerance=1e-8):
    n, deviations, w, explained = expected(vectors)
    assert len(rows) == len(ids) * w.shape[1]
    got = np.zeros_like(w)
    at = {k: i for i, k in enumerate(ids)}
    for r in rows:
        i, j = at[r.vec_id], r.component - 1
        got[i, j] = r.whitened
        assert (r.n, r.deviation) == (n, deviations[i]) and abs(r.explained - explained[j]) <= 1e-9 * explained[j] and r.identity_error <= 1e-9
    got *= np.sign((got * w).sum(0))
    assert np.abs(got - w).max() < tolerance


def test_op11(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = whitening.op11_whitening(spark, SF).collect()
    compare(rows, [r.vec_id for r in table], [r.embedding for r in table])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=5) * [3, 2, 1, 1, 0]], 1.0, 7) for i in range(40)]
    bad = [(100, None, 1.0, 7), (101, [1.0, None, 1.0, 1.0, 1.0], 1.0, 7), (102, [math.nan] * 5, 1.0, 7), (103, [math.inf, 0.0, 0.0, 0.0, 0.0], 1.0, 7), (104, [], 1.0, 7), (105, [1.0], 1.0, 7), (106, [1e300] * 5, 1.0, 7)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, whitened double, component int").repartition(7)
    rows = whitened(frame).collect()
    compare(rows, [g[0] for g in good], [g[1] for g in good])
    assert {r.component for r in rows} == {1, 2, 3, 4}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [None, None]])
def test_nothing_to_whiten(spark, vectors):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert whitened(frame).collect() == []


def test_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(1, [0.0, 1.0]), (1, [2.0, 0.5]), (None, [5.0, 4.0]), (None, [5.0, 4.0])], "vec_id long, embedding array<float>")
    rows = whitened(frame).collect()
    assert sorted((r.vec_id or 0, r.component) for r in rows) == sorted([(1, 1), (1, 2), (1, 1), (1, 2), (0, 1), (0, 2), (0, 1), (0, 2)]) and {r.n for r in rows} == {4}


def test_leading_values_of_every_kind():
    rng = np.random.default_rng(0)
    shapes = [np.linspace(1, 3, 64), np.linspace(1, 3, 150), np.ones(100), np.array([5.0] * 40 + [1.0] * 60), np.array([3.0, 2.0] + [0.0] * 98), np.zeros(40), np.array([2.0])]
    for values in shapes:
        d = len(values)
        turn, _ = np.linalg.qr(rng.normal(size=(d, d)))
        a = turn @ np.diag(values) @ turn.T
        for block, most in ((16, 256), (8, 80)):
            got, vectors, _ = leading(lambda v, a=a: a @ v, d, 32, block, most)
            k = min(32, d)
            assert np.abs(got - np.sort(values)[::-1][:k]).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11
            assert np.abs(a @ vectors - vectors * got).max() < 1e-10


def test_whole_numbers_beyond_64_bits():
    x = np.array([[1 << 52, 5], [-(1 << 52), 7], [3, 1 << 51]], np.int64)
    about = Center(10**6, (int(x[:, 0].sum()), int(x[:, 1].sum())))
    scaled = about.scaled(x)
    assert scaled.tolist() == [[10**6 * int(v) - s for v, s in zip(row, about.sums, strict=True)] for row in x.tolist()]
    assert Center.deviations(scaled) == [None] * 3
    small = np.array([[3, 4], [-1, 2]], np.int64)
    assert Center.deviations(small) == [25, 5]
