"""Whitening against exact sums and a plain solve, and on awkward tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import whitening as wh

SF = "/root/testdata/sf0.001"
COLUMNS = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


def exact(vectors):
    """n, sums, covariance as whole numbers over n^2 (times n), of the distinct vectors."""
    x = sorted({tuple(math.floor(float(c) * 256) for c in v) for v in vectors})
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = np.array([[n * c - t for c, t in zip(v, s, strict=True)] for v in x], object)
    return n, s, d.T @ d


def check(df, rows):
    """rows: (id, vector) that count."""
    assert dict(df.dtypes) == COLUMNS
    n, s, total = exact([v for _, v in rows])
    v = np.array([[float(Fraction(int(c), n**3)) for c in line] for line in total])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(4, int(np.sum(values > values.sum() * 1e-12)))
    got = df.collect()
    assert len(got) == k * len(rows)
    want = {}
    for id_, vec in rows:
        x = [math.floor(float(c) * 256) for c in vec]
        d = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s, strict=True)])
        want.setdefault(id_, []).append((sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), d @ vectors[:, :k] / np.sqrt(values[:k])))
    signs = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-10
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-10)
        near = [w[r.component - 1] for dev, w in want[r.vec_id] if dev == r.deviation]
        assert any(math.isclose(abs(r.whitened), abs(w), rel_tol=1e-8, abs_tol=1e-8) for w in near)
        big = [w for w in near if abs(w) > 1e-3]
        if len(want[r.vec_id]) == 1 and big:
            signs.setdefault(r.component, set()).add(r.whitened * big[0] > 0)
    assert all(len(x) == 1 for x in signs.values())


def test_sample_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(wh.op13_double_double_whitening(spark, SF), rows)


ODD = [
    (1, [0.1, -0.2, 0.3, 7.0, 1.0]), (1, [0.1, -0.2, 0.3, 7.0, 1.0]), (2, [0.1001, -0.2, 0.3, 7.0, 1.0]), (None, [5.0, 5.5, -0.0, 0.0, 1.0]), (3, None), (4, []), (5, [1.0, None, 1.0, 1.0, 1.0]), (6, [float("nan"), 1.0, 1.0, 1.0, 1.0]),
    (7, [1.0, float("-inf"), 1.0, 1.0, 1.0]), (8, [1.0, 2.0]), (2**62 + 1, [-9.0, 3.0, 2.0, 1.0, 1.0]), (10, [0.5, 100.0, -2.0, 3.0, 1.0]), (11, [0.004, -0.004, 1e-9, -1e-9, 1.0]), (12, [3.0, 3.0, 8.0, 2.0, 1.0]),
]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3).withColumns({c: F.lit(f"extra {c}") for c in ("id", "x", "v", "i", "n", "component", "size", "whitened")})


def test_odd_tables(spark):
    whole = [(i, np.float32(v).tolist()) for i, v in ODD if v and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v)]
    check(wh.whiten(frame(spark, ODD)), whole)
    for rows in ([], [(3, None), (4, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        df = wh.whiten(frame(spark, rows))
        assert dict(df.dtypes) == COLUMNS and df.count() == 0
    check(wh.whiten(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.0])])), [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.0])])


def test_large_offsets_lose_no_digits(spark):
    """Entries of about 2^40 that differ by a few units: a plain covariance in doubles would keep nothing."""
    base = 2.0**40
    rows = [(i, [base + (i * 37 % 11) / 256, -base + (i * i % 13) / 256, base * 2 + (i % 3)]) for i in range(60)]
    df = wh.whiten(frame(spark, rows, "double"))
    check(df, rows)


def test_covariance_is_exact_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(10**6), 10**6, (3000, 6)) * np.array([1, 10, 1, 3, 1, 1000])
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(5)
    n, total = wh.sums(fit)
    assert (n, total) == (3000, [int(c) for c in x.sum(0)])
    high, low = wh.covariance(fit, n, wh.mean_of(n, total))
    _, _, whole = exact((x / 256).tolist())
    for i in range(6):
        for j in range(6):
            true = Fraction(int(whole[i, j]), n**3)
            scale = (Fraction(int(whole[i, i]), n**3) * Fraction(int(whole[j, j]), n**3)) ** 0.5
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - true) < Fraction(scale) / 2**56


def test_pairs_of_doubles():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-9, 9, 200), rng.normal(size=200)
    for op, f in ((lambda x, y: x + y, wh.two_sum), (lambda x, y: x * y, wh.two_product)):
        for x, y, s, e in zip(a, b, *f(a, b), strict=True):
            assert Fraction(s) + Fraction(e) == op(Fraction(x), Fraction(y))


def test_deviations_of_any_size():
    x = np.array([[2**40, -5], [1, 2]])
    assert wh._deviations(np.array([[5, -5], [1, 2]]), 10, np.array([60, -30], object)) == [100 + 400, 2500 + 2500]
    assert wh._deviations(x, 10, np.array([0, 0], object)) == [None, 500]


@pytest.mark.parametrize("rows, dims", [(1, 3), (5, 40), (2000, 8)])
def test_vectors_as_many_as_there_are(spark, rows, dims):
    rng = np.random.default_rng(rows)
    data = [(i, rng.normal(size=dims).tolist()) for i in range(rows)]
    df = wh.whiten(frame(spark, data, "double"))
    if rows == 1:
        assert df.count() == 0
    else:
        check(df, data)
