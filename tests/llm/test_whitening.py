"""Whitening against numpy's eigenvectors and rational arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import whitening

SF = "/root/testdata/sf0.001"


def frame(spark, rows, names="vec_id long, embedding array<float>"):
    return spark.createDataFrame(rows, names)


def brute(vectors):
    """Integers, fit list and eigenvectors of the covariance by numpy, plainly."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    off = n * fit - sums
    v = (off.T @ off) / Fraction(n**3)
    v = np.array([[float(c) for c in row] for row in v])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, sums, strict=True))) for r in x]
    centred = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(r, sums, strict=True)] for r in x])
    return n, deviation, centred, e[order], u[:, order], np.trace(v)


def check(spark, vectors, wanted=16):
    got = whitening.whiten(frame(spark, [(k, [float(c) for c in v]) for k, v in enumerate(vectors)]), wanted=wanted).toPandas()
    n, deviation, centred, e, u, trace = brute(vectors)
    m = got["component"].max()
    assert len(got) == len(vectors) * m and m == min(wanted, (e > 1e-9 * e[0]).sum())
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for j in range(m):
        own = got[got["component"] == j + 1].sort_values("vec_id")
        assert own["deviation"].tolist() == deviation
        assert own["explained"].iloc[0] == pytest.approx(e[j] / trace, rel=1e-9)
        w = centred @ u[:, j] / math.sqrt(e[j])
        sign = 1 if w @ own["whitened"].to_numpy() > 0 else -1
        assert np.abs(own["whitened"].to_numpy() - sign * w).max() < 1e-7
    return got


def test_given_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check(spark, [r["embedding"] for r in rows][:120])


def test_low_rank_and_repeats(spark):
    draw = np.random.default_rng(1).normal(size=(40, 2))
    vectors = np.round(draw @ np.array([[64, 0, 64, 128], [0, 64, 64, -64]])) / 64
    check(spark, [*vectors, *vectors[:7]])


def test_equal_roots(spark):
    vectors = [[1.0, 0, 0], [-1.0, 0, 0], [0, 1.0, 0], [0, -1.0, 0], [0, 0, 0.25], [0, 0, -0.25]]
    got = whitening.whiten(frame(spark, [(k, [float(c) for c in v]) for k, v in enumerate(vectors)])).toPandas()
    assert sorted(set(got["component"])) == [1, 2, 3] and got["identity_error"].iloc[0] < 1e-12
    first = got[got["component"] <= 2].pivot(index="vec_id", columns="component", values="whitened")
    assert np.allclose((first**2).sum(axis=1)[:4], 3) and np.allclose(first.loc[4:], 0)


def test_polynomial_against_exact(spark):
    draw = np.random.default_rng(3).integers(-9, 10, (5, 7)).astype(object)
    a = draw @ draw.T
    # Faddeev and Le Verrier's recurrence, in whole numbers
    m, c, want = np.zeros((5, 5), dtype=object), 1, [1]
    for k in range(1, 6):
        m = a @ m + c * np.eye(5, dtype=int).astype(object)
        c = -int(np.trace(a @ m)) // k
        want.append(c)
    assert whitening.characteristic_polynomial(spark, a) == want[::-1]


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (None, [1.0, 2.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [1.0]), (9, [])]
    wide = frame(spark, rows).selectExpr("*", "1 as component", "2 as n", "3 as `a.b`", "4 as y", "5 as c")
    got = whitening.whiten(wide).toPandas()
    assert len(got) == 8 and set(got["n"]) == {3} and sorted(got["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 7, 7, 7, 7]
    for few in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        got = whitening.whiten(frame(spark, few))
        assert got.count() == 0 and got.columns == "vec_id component n deviation whitened explained identity_error".split()


def test_huge_entries(spark):
    got = whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 7.0])])).toPandas()
    assert got["deviation"].isna().all() and got["identity_error"].iloc[0] < 1e-6
