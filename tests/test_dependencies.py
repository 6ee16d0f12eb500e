"""The dependency search against plain counting."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from plumbline.operators import dependencies as D


def plain(rows, columns, error, min_groups, max_ratio, max_size=2):
    """All minimal dependencies by counting every set."""
    norm = [[(v or "").strip().lower() or None for v in r] for r in rows]
    found = []
    for size in range(1, max_size + 1):
        new = []
        for s in itertools.combinations(range(len(columns)), size):
            for a in range(len(columns)):
                if a in s or len({r[a] for r in norm if r[a]}) < 2 or any(set(t) < set(s) and b == a for t, b, *_ in found):
                    continue
                groups = defaultdict(Counter)
                for r in norm:
                    if r[a] and all(r[k] for k in s):
                        groups[tuple(r[k] for k in s)][r[a]] += 1
                n = sum(sum(c.values()) for c in groups.values())
                bad = n - sum(max(c.values()) for c in groups.values())
                if len(groups) >= min_groups and len(groups) <= max_ratio * n and bad <= error * n:
                    new.append((s, a, n, len(groups), bad))
        found += new
    return [(tuple(columns[k] for k in s), columns[a], n, g, bad) for s, a, n, g, bad in found]


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, seed):
    r = random.Random(seed)
    columns = ["a", "b", "c", "d", "key", "same", "few"]
    rows = []
    for k in range(400):
        a, b = r.randrange(8), r.randrange(7)
        c = (a * 3 + b) % 11 if r.random() > 0.03 else r.randrange(11)
        row = [f" A{a}", f"b{b}", f"c{c}", f"d{a % 3}" if r.random() > 0.02 else "d9", f"k{k}", "one", f"f{k % 5}" if r.random() > 0.5 else None]
        rows.append([None if r.random() < 0.02 else v for v in row])
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "__row__ long, " + ", ".join(f"{c} string" for c in columns))
    got = D.search(df, columns, error=0.06)
    want = plain(rows, columns, 0.06, 5, 0.6)
    assert sorted((d.determinants, d.dependent, d.evaluated, d.groups, d.violations) for d in got) == sorted(want)
    assert (("a", "b"), "c") in {(d.determinants, d.dependent) for d in got} and (("a",), "d") in {(d.determinants, d.dependent) for d in got}
    bad = D.contradictions(df, got).groupBy("determinants", "dependent").count().collect()
    assert {(x["determinants"], x["dependent"]): x["count"] for x in bad} == {(", ".join(d.determinants), d.dependent): d.violations for d in got if d.violations}


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "__row__ long, a string, b string")
    assert D.search(empty, ["a", "b"]) == [] and D.contradictions(empty, []).count() == 0
    assert D.frame(empty, []).count() == 0


def test_separators_keep_values_apart(spark):
    rows = [(k, x, y, z) for k, (x, y, z) in enumerate([("p\x1fq", "r", "1"), ("p", "q\x1fr", "2")] * 20)]
    df = spark.createDataFrame(rows, "__row__ long, x string, y string, z string")
    assert {d.groups for d in D.search(df, ["x", "y", "z"], min_groups=2)} == {2}
