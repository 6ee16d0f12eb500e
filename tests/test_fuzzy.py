"""All similar pairs of a block, whatever its size, against comparing every two records."""

import itertools
import random
import time

import numpy as np
import pytest

from plumbline.functions import wordsets
from plumbline.functions.similarity import token_set
from plumbline.operators import fuzzy, records


def drawn(seed, n):
    r = random.Random(seed)
    first, last = ["ann", "anna", "annika", "bob", "bobby", "cid", "dora"], ["lee", "leigh", "ray", "fox", "foxx", "van der berg", "vanderberg"]
    out = []
    for k in range(n):
        text = f"{r.choice(first)} {r.choice(last)} p{r.randrange(40)} mail com {r.choice(['', '555 01' + str(r.randrange(99))])}".strip()
        if r.random() < 0.2:
            text = text.replace(r.choice(text), r.choice("aeiou "), 1)
        keys = r.sample(["n:all", f"n:{text[:3]}", f"e:{r.randrange(9)}"], r.randrange(1, 4)) if r.random() < 0.95 else []
        out.append((k, text, keys))
    return out


def brute(rows, threshold):
    found = {}
    for (a, x, p), (b, y, q) in itertools.combinations(rows, 2):
        if set(p) & set(q) and (s := token_set(x, y)) >= threshold:
            found[a, b] = s
    return found


SCHEMA = "row long, text string, keys array<string>"


@pytest.mark.parametrize(("joined", "tile", "threshold"), [(48, 2000, 88), (2, 7, 88), (2, 40, 70), (0, 5, 95)])
def test_pairs(spark, monkeypatch, joined, tile, threshold):
    monkeypatch.setattr(fuzzy, "JOINED", joined)
    monkeypatch.setattr(fuzzy, "TILE", tile)
    rows = drawn(joined + tile, 260)
    got = {(r["a"], r["b"]): r["score"] for r in fuzzy.pairs(spark.createDataFrame(rows, SCHEMA), threshold).collect()}
    want = brute(rows, threshold)
    assert got == pytest.approx(want) and len(want) > 20


@pytest.mark.parametrize(("joined", "tile", "first", "searched"), [(48, 2000, 500, 20000), (2, 30, 9, 500), (0, 5, 6, 17), (300, 5, 6, 17)])
def test_connections(spark, monkeypatch, joined, tile, first, searched):
    for name, value in (("JOINED", joined), ("TILE", tile), ("FIRST", first), ("SEARCHED", searched)):
        monkeypatch.setattr(fuzzy, name, value)
    rows = drawn(joined + first, 260)
    for threshold in (88, 97):
        pairs = brute(rows, threshold)
        of = {k: k for p in pairs for k in p}
        for a, b in pairs:
            old, new = sorted((of[a], of[b]), reverse=True)
            of = {k: new if c == old else c for k, c in of.items()}
        got = fuzzy.connections(spark.createDataFrame(rows, SCHEMA), threshold)
        assert {tuple(r) for r in got.collect()} <= set(pairs)
        assert dict(map(tuple, records.components(got).collect())) == of and of


def test_large_block_needs_few_comparisons(monkeypatch):
    """One component of 3,000 records takes a fraction of its 4.5 million pairs to find, and its pairs take seconds."""
    r, n = random.Random(1), 3000
    texts = [f"ann lee person{k} mail com {r.randrange(200, 900)} {r.randrange(100, 999)} {r.randrange(1000, 9999)}" for k in range(n)]
    pairs, compare = 0, wordsets.WordSets.compare

    def counting(self, rows, others, threshold, within=False):
        nonlocal pairs
        pairs += len(rows) * len(others) // (2 if within else 1)
        return compare(self, rows, others, threshold, within)

    monkeypatch.setattr(wordsets.WordSets, "compare", counting)
    joined = len(wordsets.WordSets(texts).links(np.arange(n), 75))
    assert joined > n * 0.95 and pairs < n * n / 8
    began = time.process_time()
    found = sum(1 for _ in fuzzy.similar(texts, texts, 75, True))
    assert found > 10 * n and time.process_time() - began < 10


def test_bounds_lose_nothing():
    r = random.Random(2)
    words = ["a", "ab", "abc", "abcd", "b", "ba", "cab", "x1", "x12", "é"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 6))) for _ in range(150)]
    for threshold in (50, 75, 88, 99, 100):
        want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if token_set(texts[i], texts[j]) >= threshold}
        assert {(i, j) for i, j, _ in fuzzy.similar(texts, texts, threshold, True)} == want
        assert {(i, j) for i, j, _ in fuzzy.similar(texts[:70], texts[70:], threshold, False)} == {(i, j - 70) for i, j in want if i < 70 <= j}


def test_copies_and_limit(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "JOINED", 4)
    texts = ["ann lee", "ann lee", "ann leigh", "ann lee jr", "bob ray", "bob ray", "annika", "ann lee"] + ["cid fox"] * 600
    data = [(k, t, [f"n:{t[:3]}"] if k != 7 else []) for k, t in enumerate(texts)]
    rows = spark.createDataFrame(data, SCHEMA)
    got = {tuple(r) for r in records.components(fuzzy.links(rows)).collect()}
    assert {n for n, c in got if c == 8} == set(range(8, 608)) and {n for n, c in got if c == 0} >= {0, 1, 3} and 7 not in {n for n, _ in got}
    assert fuzzy.block_sizes(rows).where("members > 10").collect()[0].members == 600
    assert fuzzy.pairs(rows, 88, 10).where("a >= 8").count() == 0 and fuzzy.representatives(rows).count() == 7


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fuzzy.pairs(empty).count() == 0 and fuzzy.links(empty).count() == 0
    none = spark.createDataFrame([(1, "a b", None), (2, "a b", None)], SCHEMA)
    assert fuzzy.links(none).count() == 0
