"""Whitening against exact fractions and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from screenlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int"


def plain(rows, components=16):
    """vec_id -> (deviation, |whitened| by component), n, explained."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(t) for t in {tuple(x) for _, x in kept}]
    n, dim = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(dim)]
    centred = np.array([[float(Fraction(n * x[d] - s[d], n)) for d in range(dim)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, dim)
    out = [(i, sum((n * x[d] - s[d]) ** 2 for d in range(dim)), np.array([float(Fraction(n * x[d] - s[d], n)) for d in range(dim)]) @ u[:, :k] / np.sqrt(e[:k])) for i, x in kept]
    return out, n, e[:k] / np.trace(v)


def made(seed, n, dim):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in r.normal(size=dim) * np.linspace(1, 3, dim)], "x", 1) for i in range(n)]


@pytest.mark.parametrize(("n", "dim"), [(300, 5), (400, 20)])
def test_matches_plain_version(spark, n, dim, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_SUMS", 7)  # several aggregations
    rows = made(3, n, dim)
    rows += [(1000 + i, rows[0][1], "copy", 2) for i in range(150)]  # a third of all rows is one vector
    rows += [(2000, None, None, None), (2001, [None] * dim, "", 0), (2002, [float("nan")] * dim, "", 0), (2003, [float("inf")] + [0.0] * (dim - 1), "", 0), (None, rows[1][1], "", 0)]
    want, size, explained = plain(rows)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    k = min(16, dim)
    assert len(got) == len(want) * k and {r.n for r in got} == {size}
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id is None, r.vec_id), {})[r.component] = r
    signs = np.sign([by_row[(False, 0)][c + 1].whitened for c in range(k)]) * np.sign(want[0][2])
    for i, deviation, w in want:
        mine = by_row[(i is None, i)]
        assert {x.deviation for x in mine.values()} == {deviation}
        np.testing.assert_allclose([mine[c + 1].whitened for c in range(k)], w * signs, rtol=1e-7, atol=1e-8)
        np.testing.assert_allclose([mine[c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_lengths_repeats_and_directions_without_variance(spark):
    rows = [(1, [1.0, 0.0], "", 0), (1, [1.0, 0.0], "", 0), (2, [2.0, 0.0], "", 0), (3, [5.0], "", 0), (4, [], "", 0), (5, [1.0, 2.0, 3.0], "", 0)]
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 9)), r.explained) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
    # the two distinct vectors of length 2 differ in one direction; single vectors don't vary
    assert got == [(1, 1, 2, 4096, 1.0, 1.0)] * 2 + [(2, 1, 2, 4096, 1.0, 1.0)]


def test_deviations_beyond_64_bits(spark):
    rows = [(0, [0.0], "", 0), (1, [4.5e7], "", 0), (2, [5.5e7], "", 0), (3, [1e8], "", 0)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: d if d < 2**63 else None for i, d, _ in plain(rows)[0]}
    assert got == want and None in want.values() and any(want.values())


def test_long_vectors_and_empty_table(spark):
    got = whitening.whiten(spark.createDataFrame(made(4, 300, 100), SCHEMA)).collect()
    assert len(got) == 300 * 16 and max(r.identity_error for r in got) < 1e-8
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
