"""The pipeline's near-copy stage against brute force over all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import nearcopies


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_components(rows):
    sets, root = {i: shingled(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_equal_brute_force(spark):
    rng, rows = random.Random(8), []
    line = [f"line{k}" for k in range(12)]
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((5, 9, 30, 120, 400)))]
        for k in range(6):  # around 0.8: each edit costs five of the shingles
            rows.append(edited(rng, base, k * max(1, len(base) // 60)))
        rows.append(" ".join(line + base[: rng.randrange(1, 12)]))
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):  # neighbours are alike, ends are not
        chain[k * 16 + 3] = f"other{k}"
        rows.append(" ".join(chain))
    rows += ["short one", "Short  ONE", "short two", *[" ".join(line)] * 5, "a b c d e f", "a b c d e g"]
    rng.shuffle(rows)
    rows = [*enumerate(rows), (900, "x " * 50), (901, "x " * 70)]
    want = brute_components([r for r in rows if r[1]])
    got = {r._id: r.component for r in nearcopies.near_copies(spark.createDataFrame(rows, "_id long, text string")).collect()}
    assert got == {i: c for i, c in want.items() if i != c} and len(got) > 30
    none = nearcopies.near_copies(spark.createDataFrame([(4, None), (2, ""), (7, " \n")], "_id long, text string"))
    assert {tuple(r) for r in none.collect()} == {(4, 2), (7, 2)}
    assert nearcopies.near_copies(spark.createDataFrame([], "_id long, text string")).count() == 0


def test_pipeline_stage_finds_what_three_bits_miss(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    rows = [(k, edited(rng, base, 5) if k else " ".join(base), 1) for k in range(20)]
    docs = spark.createDataFrame([*rows, (50, "something else", 1)], "doc_id long, text string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "")
    want = {i for i, c in brute_components([r[:2] for r in rows] + [(50, "something else")]).items() if i == c}
    assert {r.doc_id for r in left.select("doc_id").collect()} == want and len(want) < 5


def test_shingles_met_often_change_no_result(spark, monkeypatch):
    rng = random.Random(10)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, edited(rng, base, k % 4)) for k in range(40)]
    want = {i: c for i, c in brute_components(rows).items() if i != c}
    for frequent in (1, 50):
        monkeypatch.setattr(nearcopies, "FREQUENT", frequent)
        found = nearcopies.near_copies(spark.createDataFrame(rows, "_id long, text string")).agg(F.collect_list(F.struct("_id", "component"))).first()[0]
        assert {r._id: r.component for r in found} == want


def test_simhash_proposes_and_shingles_decide(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for g in range(10):
        base = [f"w{g}x{rng.randrange(9000)}" for _ in range(3000)]
        rows += [(10 * g + k, edited(rng, base, k)) for k in range(4)]
    rows += [(200 + k, f"word{k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "_id long, t string").select("_id", F.col("t").cast("binary").alias("t"))
    sets = {i: shingled(t) for i, t in rows}
    sizes = spark.createDataFrame([(i, len(x)) for i, x in sets.items()], "_id long, n long")
    found = {tuple(r) for r in nearcopies.by_fingerprints(docs, sizes).collect()}
    assert len(found) > 10 and all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in found)
    called = []
    plain = nearcopies.simhash.links
    monkeypatch.setattr(nearcopies.simhash, "links", lambda *a: called.append(1) or plain(*a))
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars long"), "")
    assert {r.doc_id for r in left.collect()} == {i for i, c in brute_components(rows).items() if i == c} and called


def test_one_shingle_stands_for_a_group_of_documents(spark):
    rows = [(t, i) for t in range(50) for i in range(20)] + [(t, i) for t in range(50, 60) for i in range(19)]
    kept = nearcopies.once_a_group(spark.createDataFrame(rows, "token long, _id long")).collect()
    assert sorted(tuple(r) for r in kept) == [(t, i) for t, k in ((0, 20), (50, 19)) for i in range(k)]
