"""The range join against comparing every pair."""

import random

import pytest

from plumbline.operators.ranges import in_ranges


@pytest.mark.parametrize(("seed", "span"), [(1, 30), (2, 5000), (3, 1 << 60)])
def test_pairs(spark, seed, span):
    r = random.Random(seed)
    ranges = [(k, a, a + r.choice([0, 0, 1, 5, span // 3, span, -1])) for k in range(120) for a in [r.randrange(-span, span)]]
    ranges = [(k, a, min(b, (1 << 61) - 1)) for k, a, b in ranges] + [(998, None, 3), (999, 3, None), (997, -(1 << 61), (1 << 61) - 1)]
    values = [(k, r.choice([r.randrange(-span, span), ranges[k % 100][1], ranges[k % 100][2]])) for k in range(300)] + [(900, None)]
    v, w = spark.createDataFrame(values, "k long, x long"), spark.createDataFrame(ranges, "r long, a long, b long")
    want = sorted((k, q) for k, x in values for q, a, b in ranges if None not in (x, a, b) and a <= x <= b)
    got = in_ranges(v, w, "x", "a", "b")
    assert sorted((p["k"], p["r"]) for p in got.collect()) == want and set(got.columns) == {"k", "x", "r", "a", "b"}
    few = w.where("r < 20")
    hit = {k for k, q in want if q < 20}
    assert {p["k"] for p in in_ranges(v, few, "x", "a", "b", "left_semi").collect()} == hit
    assert {p["k"] for p in in_ranges(v, few, "x", "a", "b", "left_anti").collect()} == {k for k, _ in values} - hit


def test_empty(spark):
    v, w = spark.createDataFrame([(1, 2)], "k long, x long"), spark.createDataFrame([], "r long, a long, b long")
    assert in_ranges(v, w, "x", "a", "b").count() == 0 and in_ranges(v, w, "x", "a", "b", "left_anti").count() == 1 and in_ranges(v, w, "x", "a", "b", "left_semi").count() == 0
    assert in_ranges(v.limit(0), spark.createDataFrame([(1, 2, 3)], "r long, a long, b long"), "x", "a", "b").count() == 0
