"""Word-set similarities as arrays against one pair at a time, and components that grow."""

import itertools
import random

import numpy as np
import pytest

from plumbline.functions import wordsets
from plumbline.functions.similarity import token_set
from plumbline.functions.wordsets import WordSets


def drawn(seed, words, n, most):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randrange(most + 1))) for _ in range(n)]


SHORT = ["a", "ab", "abc", "abcd", "b", "ba", "cab", "x1", "x12", "é"]
LONG = [*SHORT, "longer" * 5, "longest" * 6 + "日本", "langer" * 5]


def brute(texts, threshold):
    return {(i, j): s for i, j in itertools.combinations(range(len(texts)), 2) if (s := token_set(texts[i], texts[j])) >= threshold}


def all_pairs(texts, threshold):
    sets, own, out = WordSets(texts), np.arange(len(texts)), {}
    for x, y, score in sets.compare(own, own, threshold, True):
        for i, j, s in zip(x.tolist(), y.tolist(), score.tolist(), strict=True):
            assert (min(i, j), max(i, j)) not in out
            out[min(i, j), max(i, j)] = s
    return out


@pytest.mark.parametrize(("least", "block", "rows"), [(1 << 12, 1 << 14, 256), (1, 64, 7), (100, 1000, 30)])
def test_compare(monkeypatch, least, block, rows):
    for name, value in (("LEAST_PAIRS", least), ("BLOCK", block), ("ROWS", rows)):
        monkeypatch.setattr(wordsets, name, value)
    for texts in (drawn(1, SHORT, 120, 5), drawn(2, LONG, 100, 8), ["a", "a"], ["", " "], []):
        for threshold in (30, 75, 88, 100):
            assert all_pairs(texts, threshold) == brute(texts, threshold)


def test_two_lists():
    texts = drawn(3, LONG, 90, 6)
    want = {(i, j) for i, j in brute(texts, 80) if i < 40 <= j}
    sets = WordSets(texts)
    assert {(i, j) for x, y, _ in sets.compare(np.arange(40), np.arange(40, 90), 80) for i, j in zip(x.tolist(), y.tolist(), strict=True)} == want


def parts(n, links):
    of = list(range(n))
    for a, b in links:
        old, new = of[a], of[b]
        of = [new if k == old else k for k in of]
    return {frozenset(i for i in range(n) if of[i] == c) for c in set(of)}


@pytest.mark.parametrize(("step", "rows"), [(1 << 18, 64), (50, 1), (2000, 5)])
def test_links(monkeypatch, step, rows):
    monkeypatch.setattr(wordsets, "STEP", step)
    monkeypatch.setattr(wordsets, "LEAST_ROWS", rows)
    r = random.Random(step)
    for texts in (drawn(4, SHORT, 110, 4), drawn(5, [str(k) for k in range(300)], 110, 4), ["ann lee " + str(k) for k in range(110)]):
        for threshold in (60, 88):
            pairs = set(brute(texts, threshold))
            labels = np.arange(len(texts))
            links = WordSets(texts).links(labels, threshold)
            assert {(min(p), max(p)) for p in links} <= pairs and parts(len(texts), links) == parts(len(texts), pairs) and len(links) == len(texts) - len(parts(len(texts), pairs))
            labels = np.array([r.randrange(40) for _ in texts]) * 7
            known = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if labels[i] == labels[j]]
            assert parts(len(texts), known + WordSets(texts).links(labels, threshold)) == parts(len(texts), known + list(pairs))
