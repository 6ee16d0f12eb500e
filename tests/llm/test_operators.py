"""Every operator on awkward rows and against brute force."""

import hashlib
import random
import re
import struct
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, common, decontaminate, language, licenses, quality, sharding, simhash, suffixes, toxicity, urls

LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string, kept string, _id int, `a b` string"


def awkward(spark):
    rows = [(1, None), (2, ""), (3, LONG), (4, "same text " * 30), (5, "same text " * 30), (None, "no id"), (None, None), (7, "tie"), (7, "tie"), (8, " \n\t "), (9, "é日本 😀 <|endoftext|>"), (7, "other")]
    return spark.createDataFrame([(i, t, "en", None, None, 1, "x", "y", 3, "z") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def some_words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "la", "mu"]) + str(rng.randrange(40)) for _ in range(n))


def test_sharding(spark):
    out = sharding.shuffle_shards(awkward(spark), shards=5)
    rows = out.collect()
    assert len(rows) == 12 and "a b" in out.columns and out.schema["shard"].dataType.simpleString() == "int"
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(5)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert sharding.shuffle_shards(empty(spark)).count() == 0
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    assert sharding.digests(hot).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    p = sharding.fisher_yates(1000, 3)
    assert sorted(p) == list(range(1000)) and (p != np.arange(1000)).sum() > 900


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    out = bpe.encode_documents(awkward(spark), path)
    assert "a b" in out.columns
    for r in out.collect():
        want = known.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == known.decode(want, skip_special_tokens=False)
    assert bpe.digests(empty(spark), path).count() == 0
    d = {r.doc_id: r for r in bpe.digests(awkward(spark).where("doc_id = 9"), path).collect()}[9]
    ids = known.encode("é日本 😀 <|endoftext|>", add_special_tokens=False).ids
    assert d.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_language(spark):
    rng = random.Random(1)
    en, de = ["the and of to with house water"], ["der und die mit haus wasser nicht"]
    docs = [(i, " ".join(rng.choices((en if i % 2 else de)[0].split(), k=40)), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(80)]
    docs = spark.createDataFrame([*docs, (90, None, None, None, None), (91, "", "en", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(1, "http://x.de/a", "<html lang='de'><body>der und die mit <b>haus</b></body>"), (2, None, None), (3, "http://x.de/b", "<html lang=en>"), (3, "http://x.de/b", "<html lang=en>")], "page_id long, url string, html string")
    rows = language.languages(docs, pages).collect()
    assert len(rows) == 86
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].lang == ("en" if i % 2 else "de") for i in range(80)) and by[90].lang == "und"
    assert sorted((r.page_id, r.lang) for r in rows if r.page_id)[:2] == [(1, "de"), (2, "und")]
    assert language.languages(docs, pages.limit(0)).count() == 82
    none = language.languages(docs.limit(0), pages).collect()
    assert [(r.lang, r.probability, r.text_lang) for r in none] == [("und", 0.0, "und")] * 4
    one = {r.doc_id: r for r in language.languages(docs.where("lang = 'de' or doc_id = 90").withColumn("_id", F.lit(1)), pages).collect()}
    assert (one[2].lang, one[2].probability, one[90].lang) == ("de", 1.0, "und")
    rare = docs.unionByName(spark.createDataFrame([(95, "lumi nari lumi tako nari", "fi-FI", None, 1), (96, "tako lumi", "not a tag", None, 1)], docs.schema))
    assert language.train(rare)[0] == ["de", "en", "fi"] and {r.doc_id: r.lang for r in language.languages(rare, pages).collect()}[95] == "fi"


def test_many_languages(spark, monkeypatch):
    """150 languages, sent in parts: each text is found to be of its own; posteriors equal those worked out plainly."""
    monkeypatch.setattr(language, "SENT_LANGUAGES", 64)
    rng = random.Random(4)
    tags = [a + b for a in "abcdefghijklmno" for b in "pqrstuvwxy"]
    words = {t: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)] for t in tags}
    rows = [(k, " ".join(rng.choices(words[t], k=12)), t, f"s{k % 7}", 1) for k, t in enumerate(tags * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(1, "http://w.x.de/a", f"<html lang='{tags[3]}'>{' '.join(words[tags[3]])}")], "page_id long, url string, html string")
    got = language.languages(docs, pages).collect()
    assert {r.doc_id: r.lang for r in got if r.doc_id is not None} == {r[0]: r[2] for r in rows}
    assert [r.lang for r in got if r.page_id == 1] == [tags[3]]
    langs, table = language.train(docs)
    own = docs.where("doc_id < 3").selectExpr("doc_id", "cast(text as binary) t", "false markup", "cast(null as string) declared", "source host")
    ll = {r.doc_id: np.array(r.ll) for r in language.text_evidence(own, table).collect()}
    q = {k: np.exp(v - v.max()) / np.exp(v - v.max()).sum() for k, v in ll.items()}
    share = (sum(q.values()) + 1) / (3 + len(langs))
    for r in language.identify(own, langs, table).collect():
        # each host is its own domain and has this text alone, so nothing but the share is left of both
        post = np.exp(ll[r.doc_id] - ll[r.doc_id].max()) * share
        assert r.probability == pytest.approx((post / post.sum()).max()) and r.lang == langs[post.argmax()]


def test_language_of_a_text_does_not_depend_on_its_neighbour(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc de"), False), (2, bytearray(b"xyz"), False), (3, bytearray(b""), False), (4, bytearray(b"abc de"), False), (5, bytearray(b"q"), False)], "k long, t binary, markup boolean").coalesce(1)
    table = np.random.default_rng(2).normal(size=(language.SLOTS, 3)).astype(np.float32)
    got = {r.k: r for r in language.text_evidence(rows, table).collect()}
    assert np.allclose(got[1].ll, got[4].ll) and got[3].ll == [0, 0, 0]
    at = language.slots_of(np.frombuffer(b" abc de ", np.uint8))
    assert np.allclose(got[1].ll, table[at].sum(axis=0), rtol=1e-5) and got[1].n == 6


def test_urls(spark):
    rows = [(1, "http://a.org/x", '<link rel="canonical" href="https://example.com/en/5">'), (2, "http://b.org/y?q=1", '<meta http-equiv=refresh content="0; url=http://a.org/x">'), (3, "http://c.org/p", "<link href=/q/ rel=canonical>"), (4, "http://c.org/q/", '<LINK REL="canonical" HREF="http://z.example.com/en/71">'), (5, "http://c.org/q/", '<link rel=canonical href="http://w.com/en/1">'), (6, None, None), (7, "nohost", "x"), (8, "HTTP://Ab.NET/de/8?x#y", ""), (9, "http://example.net/de/8", None), (None, "http://c.org/q/", "")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, node int")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("net/de/", "block"), 9: ("example.net/de/8", "block"), None: (None, "allow")}
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(9)
    good = "This is a plain line of ordinary words that reads well.\n" + "".join(f"Then {''.join(rng.choices('abcdefghij', k=5))} {''.join(rng.choices('aeioumnlr', k=6))} and {''.join(rng.choices('stuvaeiou', k=5))} came by.\n" for _ in range(12))
    junk = "".join(f"BUY{i}!! NOW{i}!! CHEAP{i}!! ### $$$ %%% &&&\n" for i in range(30))
    docs = spark.createDataFrame([(i, good.replace("plain", f"plain{i}") if i % 2 else junk.replace("NOW", f"NOW{i}")) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality(docs, quality.train(docs, labels)).collect()}
    assert all(rows[i].kept == bool(i % 2) for i in range(40))
    assert quality.quality(awkward(spark), quality.plain_field()).count() == 12
    assert quality.train(docs, labels.limit(0)).unary.tolist() == quality.plain_field().unary.tolist()
    r = quality.read("a b c a b c x\nline\nline\n\n".encode())
    assert r[0] == (9, 15, 0, 1, 6)
    f = quality.plain_field()
    rng = random.Random(2)
    for _ in range(20):
        x = [quality.line_features(w, w.split(), False) for w in (rng.choice([b"GOOD!! #", b"a plain line", b"12 12 12"]) for _ in range(5))]
        best = max(range(32), key=lambda m: sum(f.unary[t].sum() for k, t in enumerate(x) if m >> k & 1) + sum(f.pair[m >> k & 1, m >> k + 1 & 1] for k in range(4)))
        assert f.viterbi(x) == [best >> k & 1 for k in range(5)]


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(awkward(spark)).collect()}
    assert rows[1, "0" * 16] is None and rows[5, f"{brute_fingerprint('same text ' * 30):016x}"] == 4
    assert simhash.near_duplicates(empty(spark)).count() == 0
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for x in base for _ in range(12)}
    pairs = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    assert {frozenset((r.src, r.dst)) for r in got} == {frozenset(map(signed, p)) for p in pairs} and len(got) == len(pairs)


def brute_removed(rows, n):
    seen, out = {}, {}
    for i, t in sorted(rows):
        hit = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if t[p : p + n] in seen:
                hit[p : p + n] = b"\1" * n
            else:
                seen[t[p : p + n]] = 1
        out[i] = bytes(c for c, x in zip(t, hit, strict=True) if not x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, seed):
    rng = random.Random(seed)
    shared = [some_words(rng, 25) for _ in range(4)]
    texts = ["".join(rng.choice([*shared, some_words(rng, 8), "a" * rng.randrange(150), "é"]) for _ in range(rng.randrange(7))) for _ in range(60)]
    docs = spark.createDataFrame([(i * 3 - 50, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    got = {r.doc_id: bytes(r.kept) for r in suffixes.without_repeats(docs).collect()}
    assert got == brute_removed([(i * 3 - 50, t.encode()) for i, t in enumerate(texts)], 100)
    whole = suffixes.without_repeats(docs, characters=True).select(F.try_validate_utf8(F.col("kept").cast("string")).isNotNull().alias("ok"))
    assert whole.where("not ok").count() == 0


@pytest.mark.parametrize("often", [2, 2000])
def test_suffixes_with_a_passage_in_most_texts(spark, monkeypatch, often):
    """Anchors with very many contexts, within a batch and over all, are split."""
    monkeypatch.setattr(suffixes, "OFTEN", often)
    monkeypatch.setattr(suffixes, "BUCKET_PASSAGES", 500)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 100)
    rng = random.Random(8)
    shared, other = some_words(rng, 22), some_words(rng, 14)
    texts = [some_words(rng, 6) + rng.choice([shared, shared[:110], other]) + some_words(rng, rng.randrange(9)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for parts in (1, 7):
        got = {r.doc_id: bytes(r.kept) for r in suffixes.without_repeats(docs.repartition(parts)).collect()}
        assert got == brute_removed([(i, t.encode()) for i, t in enumerate(texts)], 100)


def test_multikey_order_and_bytes():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 3, (20_000, 16), np.uint8)
    rows[:, :9] = rows[:1, :9]
    order = suffixes.multikey_order(rows)
    assert [bytes(rows[k]) for k in order] == sorted(map(bytes, rows))
    data = rng.integers(0, 2, 500, np.uint8)
    one, other, size = rng.integers(0, 480, 900), rng.integers(0, 480, 900), rng.integers(1, 6, 900)
    want = [bytes(data[a : a + n]) == bytes(data[b : b + n]) for a, b, n in zip(one, other, size, strict=True)]
    assert suffixes.same_bytes(data, one, other, size).tolist() == want


def test_suffixes_of_equal_hashes(spark, monkeypatch):
    """Bytes decide: contexts whose hashes agree are not equal for that."""
    texts = [bytes(np.random.default_rng(k).integers(97, 123, 300, np.uint8)) for k in range(4)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([300] * 4)
    runs = suffixes.passage_runs(data, ends, 100, 32)
    monkeypatch.setattr(suffixes, "passage_runs", lambda *a: {**runs, "c": runs["c"] * 0, "h": runs["h"] * 0})
    h, salt, kind, *_ = suffixes.marks_of(np.arange(4), pa.array(texts, pa.binary()), 100, 32)
    assert (kind != suffixes.REPEAT).all()


def test_suffixes_awkward(spark):
    out = suffixes.digests(awkward(spark)).collect()
    assert len(out) == 12 and sum(r.n_removed for r in out if r.doc_id == 5) == 300 and all(r.n_removed == 0 for r in out if r.doc_id == 4) is False
    assert suffixes.digests(empty(spark)).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(i, some_words(rng, 60) + (" you vile scumbag" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, LONG)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    none = toxicity.toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0]
    assert none == 0 and toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.without_toxic(docs, toxicity.train(docs, labels)).count() < 330


def test_decontaminate(spark):
    rng = random.Random(5)
    items = [some_words(rng, n) for n in (30, 14, 6, 3)]
    cut = items[0].split()
    cut[5], cut[11] = "changed", "too"
    docs = [(1, some_words(rng, 50) + " " + items[0].upper() + "! " + some_words(rng, 9)), (2, " ".join(cut)), (3, some_words(rng, 400)), (4, items[1]), (5, "x " + items[2]), (6, items[3]), (7, None), (8, ""), (9, LONG), (None, items[1]), (4, "other")]
    docs = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, words int")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (1, items[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 1), (5, 2), (6, 3), (None, 1)} and got[1, 0] == 1
    assert decontaminate.contamination(docs, bench.limit(0)).count() == decontaminate.contamination(docs.limit(0), bench).count() == 0


def brute_contamination(docs, items):
    """Every offset of every document and item, word by word."""
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    out = {}
    for i, t in docs:
        for j, u in items:
            d, b = words(t), words(u)
            width = min(13, len(b))
            for shift in range(-len(b), len(d) + 1) if b else []:
                skip = max(-shift, 0)
                n = min(len(b), len(d) - shift) - skip
                same = [d[skip + shift + k] == b[skip + k] for k in range(max(n, 0))]
                top = max((sum(same[k : k + width]) for k in range(n - width + 1)), default=0)
                if top / width >= 0.8:
                    old = out.get((i, j), (0, 0))
                    out[i, j] = (max(old[0], top), max(old[1], n))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontaminate_finds_every_offset(spark, seed, monkeypatch):
    """Items of all lengths, with up to three words substituted anywhere; also with no side small enough to send."""
    if seed == 3:
        monkeypatch.setattr(decontaminate, "SEED_LIMIT", -1)
    rng = random.Random(seed)
    items = [(k, some_words(rng, n)) for k, n in enumerate([1, 2, 3, *range(4, 16), 40])]
    docs = []
    for k in range(150):
        own = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(["new", "alpha1"])
        docs.append((rng.choice([k, k, k // 2, None]), " ".join([some_words(rng, rng.randrange(4)), *own, some_words(rng, rng.randrange(4))])))
    want = {}
    for key, (same, n) in ((key, x) for d in docs for key, x in brute_contamination([d], items).items()):
        old = want.get(key, (0, 0))
        want[key] = (max(old[0], same), max(old[1], n))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_same, r.n_overlap) for r in got} == want and len(want) > 50


def test_masks_find_every_allowed_substitution():
    for width in range(1, 14):
        wrong = decontaminate.wrong_words(width, 0.8)
        masks = decontaminate.masks_for(width, wrong)
        assert all(any(not {p + k for p in m} & set(c) for m in masks for k in range(width - m[-1])) for c in combinations(range(width), wrong))
    assert [decontaminate.wrong_words(w, 0.8) for w in (4, 5, 9, 10, 13)] == [0, 1, 1, 2, 2] and len(decontaminate.masks_for(13, 2)) == 1


def test_licenses(spark):
    text = "Intro words. Licensed under the\nApache License, Version 2.0.\nSPDX-License-Identifier: MIT\nAlso CC BY-NC 4.0 and the GNU General Public License"
    n, base, first, last, base_labels, labels, score = licenses.scan(text.encode())
    assert (base, base_labels, labels) == (3, "apache,cc-by,gpl", "apache,cc-by,cc-by-nc,gpl,mit") and first == 5 and last > first and 0.9 < score <= 1
    assert licenses.scan(None) == (0, 0, None, None, "", "", 0.0) and len(licenses.rules()) > 200
    assert licenses.licenses(awkward(spark)).count() == 12 and licenses.licenses(empty(spark)).count() == 0
    rng = random.Random(1)
    level = [40, 30, 10, 20, 30]
    for _ in range(500):
        found = list({(a, a + rng.randrange(1, 8), rng.randrange(5)) for a in [rng.randrange(12) for _ in range(rng.randrange(9))]})
        taken = []
        for s, e, k in sorted(found, key=lambda x: (-level[x[2]], x[0] - x[1], x[0], x[2])):
            if not any(a <= s and e <= b for a, b, _ in taken):
                taken.append((s, e, k))
        assert sorted(taken) == sorted(licenses.unsuppressed(found, level))
    assert licenses.detect("/*\n * permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software\n")[0][2] == "mit"
    for _ in range(200):
        words = rng.choices(["cc", "by", "mit", "license", "gnu", "general", "public", "apache", "é"], k=rng.randrange(30))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
        n, base, first, last, base_labels, _, _ = licenses.scan(", ".join(words).upper().replace("É", "é").encode())
        assert (n, base, base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (first, last) == ((min(places)[0], max(places)[0]) if places else (None, None))
    flat = text.lower()
    for r in licenses.rules():
        if r.pattern.search(flat):
            assert any(k in flat for k in r.keywords)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, k) for k in range(1001, 1100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert 0 < len(rows) <= docs.count() and {"doc_id", "text", "ids", "decoded"} <= set(out.columns)
    toxic = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & {r.doc_id for r in rows}) <= len(toxic) // 4 + 2
    empty_docs = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty_docs, "/root/testdata/sf0.001").count() == 0, name
