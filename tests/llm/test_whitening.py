"""Whitening against exact rational arithmetic and a plain eigendecomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from leaksieve.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, x string"


def result(spark, rows):
    df = spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], SCHEMA).repartition(3)
    return whitening.whitened(df).collect()


@pytest.mark.parametrize("bits", [1, 9, 20, 40, 62])
def test_cross_products_are_exact(bits):
    rng = random.Random(bits)
    x = [[rng.randrange(-(2**bits), 2**bits) for _ in range(5)] for _ in range(131)]
    for row in x:
        row[3] = 42  # a constant dimension has no planes
    s, p = whitening.cross_products(np.array(x, np.int64))
    assert list(s) == [sum(r[i] for r in x) for i in range(5)]
    assert [list(row) for row in p] == [[sum(r[i] * r[j] for r in x) for j in range(5)] for i in range(5)]


def test_the_ends_of_a_long():
    x = np.array([[2**63 - 1, -(2**63)], [-(2**63), 5]], np.int64)
    s, p = whitening.cross_products(x)
    ints = [[int(v) for v in r] for r in x]
    assert list(s) == [sum(r[i] for r in ints) for i in range(2)]
    assert p[0, 0] == sum(r[0] ** 2 for r in ints) and p[0, 1] == p[1, 0] == sum(r[0] * r[1] for r in ints)
    for v in (-1, 0, 2**47, -(2**130) + 3):
        low, mid, high = whitening._limbs(v)
        assert low + (mid << 48) + (high << 96) == v


def test_against_rational_covariance(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, s) for s in (1, 3, 0.5, 2, 0.1)] for _ in range(200)]
    rows = [(i, v) for i, v in enumerate(base)] + [(None, base[0]), (1, base[1])] * 3
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, [])]
    got = result(spark, rows + bad)
    x = [tuple(math.floor(256 * c) for c in v) for _, v in rows]
    fit = sorted(set(x))
    n = len(fit)
    s = [sum(r[i] for r in fit) for i in range(5)]
    cov = [[Fraction(n * sum(r[i] * r[j] for r in fit) - s[i] * s[j], n * n) for j in range(5)] for i in range(5)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    order = np.argsort(-values)[:4]
    assert len(got) == len(rows) * 4
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, v in enumerate(base):
        for k in range(4):
            found = by[i, k + 1]
            assert len(found) == (4 if i == 1 else 1) and len({(f.whitened, f.deviation) for f in found}) == 1
            f = found[0]
            assert f.n == n and f.deviation == sum((n * c - t) ** 2 for c, t in zip(x[i], s, strict=True)) == int(f.deviation_digits)
            want = sum(float(Fraction(n * c - t, n)) * w for c, t, w in zip(x[i], s, vectors[:, order[k]], strict=True)) / math.sqrt(values[order[k]])
            signs.setdefault(k, 1 if abs(f.whitened - want) < abs(f.whitened + want) else -1)
            assert f.whitened == pytest.approx(signs[k] * want, rel=1e-7, abs=1e-9)
            assert f.explained == pytest.approx(values[order[k]] / float(sum(cov[d][d] for d in range(5))), rel=1e-9)
            assert f.identity_error < 1e-9
    assert len(by[None, 1]) == 3


def test_odd_tables(spark):
    assert result(spark, []) == [] and result(spark, [(1, None)]) == []
    alone = result(spark, [(1, [0.5, -0.5]), (2, [0.5, -0.5])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    huge = result(spark, [(1, [1e300, 1.0]), (2, [-1e300, 3.0]), (3, [0.0, -0.001])])
    assert {r.deviation for r in huge if r.vec_id == 1} == {None}
    assert {r.deviation_digits for r in huge if r.vec_id == 1} == {str((3 * (2**63 - 1) + 1) ** 2 + (3 * 256 - (256 + 768 - 1)) ** 2)}
    assert all(r.identity_error < 1e-6 for r in huge)
