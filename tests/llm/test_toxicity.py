"""The Kneser-Ney models against a plain recursion, and both ways of scoring against each other."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import toxicity
from plumbline.llm.toxicity import ORDER


def brute(texts):
    """P(class, gram): the interpolated probability of a gram's last symbol, by the definition."""
    counts = {c: Counter() for c in (0, 1)}
    for text, toxic in texts:
        flat = toxicity.folded(text)
        for k in range(len(flat) - ORDER + 1):
            counts[toxic][flat[k : k + ORDER]] += 1
    types, below = [set(counts[0]) | set(counts[1])], []
    for _ in range(ORDER - 1):
        below.append(Counter(g[1:] for g in types[-1]))
        types.append(set(below[-1]))

    def shared(tail):
        if not tail:
            return 1 / (len(types[-1]) + 1)
        own = below[ORDER - 1 - len(tail)]
        same = [t for t in own if t[:-1] == tail[:-1]]
        total = sum(own[t] for t in same)
        if not total:
            return shared(tail[1:])
        return max(own[tail] - 0.75, 0) / total + 0.75 * len(same) / total * shared(tail[1:])

    def prob(c, gram):
        n1, n2 = (sum(v == k for v in counts[c].values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [g for g in counts[c] if g[:-1] == gram[:-1]]
        total = sum(counts[c][g] for g in same)
        if not total:
            return shared(gram[1:])
        return max(counts[c][gram] - d, 0) / total + d * len(same) / total * shared(gram[1:])

    return prob, types[0]


def test_probabilities_and_backoff(spark):
    rng = random.Random(3)
    texts = [("".join(rng.choice("abcé ß日") for _ in range(rng.randrange(1, 25))), rng.randrange(2)) for _ in range(40)]
    prob, grams = brute(texts)
    counts = toxicity.count_grams(spark.createDataFrame(texts, "text string, toxic int"))
    seen, unseen = toxicity.kneser_ney(counts)
    rows = {r.gram: r for r in seen.collect()}
    assert set(rows) == grams
    for g, r in rows.items():
        assert math.isclose(r.toxic, prob(1, g), rel_tol=1e-9) and math.isclose(r.ordinary, prob(0, g), rel_tol=1e-9)
        assert math.isclose(r.ratio, math.log(prob(1, g) / prob(0, g)), rel_tol=1e-9, abs_tol=1e-9)
    for r in unseen.collect():
        other = r.context + "z"
        assert math.isclose(r.ratio, math.log(prob(1, other) / prob(0, other)), rel_tol=1e-9, abs_tol=1e-9)
    model = toxicity.keyed(seen, unseen).toArrow()
    table = toxicity.Table(model.column("key").to_numpy(), model.column("ratio").to_numpy())
    text = "abca zzz é日ß"
    flat = toxicity.folded(text)
    want = [math.log(prob(1, flat[k : k + ORDER]) / prob(0, flat[k : k + ORDER])) for k in range(len(flat) - ORDER + 1)]
    assert math.isclose(toxicity.evidence([text], table)[0, 0], sum(want) / len(want), rel_tol=1e-5)
    assert toxicity.evidence([None, "", " 1 ", "a"], table)[:3].tolist() == [[0, 0, 0]] * 3


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "lu"]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(40)) + (" you vile scumbag " + word() if i % 4 == 0 else ""), i) for i in range(400)]
    odd = [(900, None, 1), (901, "", 1), (902, "word " * 30_000, 1), (None, "no id", 1), (None, None, 1), (5, rows[5][1], 1), (5, rows[5][1], 1)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, `a.b` int").withColumnRenamed("a.b", "_record")
    return docs, spark.createDataFrame([(i, 1, int((i or 0) % 4 == 0)) for i in [*range(400), None, 8, 8]], "doc_id long, quality int, toxic int")


def test_both_ways_give_equal_scores(spark, tables, monkeypatch):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    assert (model.weights[:-1] >= 0).all() and model.weights[:-1].max() > 0
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    sent = sorted(toxicity.score(docs, model).collect(), key=key)
    kept = toxicity.without_toxic(docs, model)
    assert len(sent) == docs.count() and kept.columns == docs.columns
    n = kept.count()
    monkeypatch.setattr(toxicity, "SENT_BYTES", 0)
    joined = sorted(toxicity.score(docs, model).collect(), key=key)
    assert [r.doc_id for r in sent] == [r.doc_id for r in joined]
    assert np.allclose([r.score for r in sent], [r.score for r in joined], atol=1e-12)
    assert toxicity.without_toxic(docs, model).count() == n and toxicity.score(docs.limit(0), model).count() == 0
    held = [r for r in sent if r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)


def test_positive_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    w = toxicity.fit_positive(x, (x @ [2.0, -1.0, 1.0] + rng.normal(size=500) > 0).astype(float))
    assert w[1] == 0 and w[0] > w[2] > 0
