"""Quantiles against numpy, and the word-set ratio against its definition."""

import random

import numpy as np

from plumbline.functions.similarity import ratio, token_set
from plumbline.operators.quantiles import quantiles


def test_quantiles(spark):
    draw = random.Random(5)
    columns = {
        "spread": [draw.gauss(0, 1e6) for _ in range(30_000)],
        "ties": [float(draw.randrange(3)) for _ in range(30_000)],
        "hot": [7.0] * 20_000 + [draw.random() for _ in range(1_000)],
        "one": [4.0],
        "two": [1.0, 2.0],
    }
    rows = [(c, x) for c, xs in columns.items() for x in xs] + [("spread", None), ("none", None)]
    found = {r["column"]: r for r in quantiles(spark.createDataFrame(rows, "column string, x double"), (0.01, 0.5, 0.99)).collect()}
    assert set(found) == set(columns)
    for c, xs in columns.items():
        assert np.allclose([found[c].q0, found[c].q1, found[c].q2], np.quantile(xs, [0.01, 0.5, 0.99]), rtol=1e-12)


def test_no_rows(spark):
    assert quantiles(spark.createDataFrame([], "column string, x double"), (0.5,)).count() == 0


def plain(a, b):
    x, y = set(a.split()), set(b.split())
    both = sorted(x & y)
    if not x or not y:
        return 0.0
    if both and (x <= y or y <= x):
        return 100.0
    shared = " ".join(both)
    left, right = (" ".join(both + sorted(s - set(both))) for s in (x, y))
    return max([ratio(left, right)] + ([ratio(shared, left), ratio(shared, right)] if both else []))


def test_token_set():
    draw = random.Random(6)
    for _ in range(2000):
        a, b = (" ".join("".join(draw.choices("abc", k=draw.randrange(1, 4))) for _ in range(draw.randrange(6))) for _ in range(2))
        assert token_set(a, b) == plain(a, b), (a, b)
