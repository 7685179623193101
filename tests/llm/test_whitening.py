"""Whitening against exact integers and numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from docspan.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, z string, n string"


def plain(rows, dims):
    """Exact x, n, S and covariance (as fractions) of usable (id, vector) rows of one length."""
    good = [(i, [math.floor(64 * Fraction(float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[float(Fraction(sum(x[a] * x[b] for x in fit) * n - sums[a] * sums[b], n * n)) for b in range(dims)] for a in range(dims)]
    return good, n, sums, np.asarray(cov)


def check(frame, rows, dims, components=16):
    good, n, sums, cov = plain(rows, dims)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    kept = [k for k in range(min(components, dims)) if values[k] > 1e-12 * values.sum()]
    got = frame.collect()
    assert len(got) == len(good) * len(kept)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-4
    z = {}
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        mine = [r for r in by_id[i] if r.deviation == deviation or deviation >= 1 << 63 and r.deviation is None]
        assert {r.component for r in mine} == {k + 1 for k in range(len(kept))} and all(r.n == n for r in mine)
        z[i] = [next(r.whitened for r in mine if r.component == k + 1) for k in range(len(kept))]
        assert all(abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-4 * values[r.component - 1] / values.sum() for r in mine)
    # a component has either sign, the same for all rows
    centred = np.asarray([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in good])
    want = centred @ axes[:, kept] / np.sqrt(values[kept])
    mine = np.asarray([z[i] for i, _ in good])
    apart = np.minimum(np.abs(mine - want).max(axis=0), np.abs(mine + want).max(axis=0))
    gaps = [min(abs(values[k] - values[j]) for j in range(dims) if j != k) / values[0] for k in kept]
    assert all(a < 1e-6 for a, gap in zip(apart, gaps) if gap > 1e-6)


def test_registered_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, sf_dir), rows, 64)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(k, 1 + k) for k in range(5)]) for i in range(40)]
    rows = [(i, np.asarray(v, np.float32).tolist()) for i, v in rows]
    rows += [(100 + k, rows[k][1]) for k in range(10)]  # copies count once in the fit
    rows += [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [1.0, float("nan"), 2.0, 3.0, 4.0]), (203, [float("inf")] * 5), (204, []), (205, [1.0, 2.0])]
    rows += [(206, [0.0] * 5), (207, [-0.0] * 5), (208, [1 / 64, -1 / 64, 0.015624, -0.015624, 1e-30])]
    frame = spark.createDataFrame([(i, v, "z", "n") for i, v in rows], SCHEMA).repartition(3)
    check(whitening.whiten(frame), rows, 5)
    check(whitening.whiten(frame, components=2), rows, 5, 2)


def test_large_entries_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 10.0 ** (3 * k)) for k in range(4)]) for i in range(30)] + [(50, [1.0, 2.0, 3.0, 4.0]), (51, [1.0, 2.0, 3.0, 4.0])]
    for scale in (1.0, 1e14):  # with the second, numbers are beyond a long
        own = [(i, [c * scale for c in v]) for i, v in rows]
        frame = spark.createDataFrame(own, "vec_id long, embedding array<double>").repartition(3)
        good, n, sums, _ = plain(own, 4)
        got = whitening.whiten(frame, components=1).collect()
        assert {r.n for r in got} == {n} == {31}
        want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in good}
        assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got)


def test_rows_that_do_not_vary(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(frame).count() == 0
    assert whitening.whiten(frame.filter("false")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(6)] + [(None, [9.0, 18.0, 7.0])], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


@pytest.mark.parametrize("top", [1, 2, 1000, 1 << 20, 1 << 40])
def test_bit_planes_give_exact_products(top):
    rng = np.random.default_rng(top)
    values = rng.integers(0, top, (130, 3)).astype(np.int64)
    exact = values.astype(object)
    assert (whitening.cross_products(values) == exact.T @ exact).all()


def test_digits():
    for value in (0, 1, -1, 1 << 39, 1 << 40, -(1 << 90) - 5, 12345678901234567890123456789):
        assert sum(d << 40 * k for k, d in enumerate(whitening._digits(value))) == value
