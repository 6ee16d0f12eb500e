"""Base spans against the plain rules, and what the trees add."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SF = "/root/testdata/sf0.001"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def fine(kind, t):
    d = re.sub("[^0-9]", "", t)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in t.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fine(k, m[0])]


def check(row, text):
    base = plain(text)
    assert [row[f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in row["spans"].split(",") if x)]
    assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
    added = sorted(((s, e) for k, s, e in spans if (k, s, e) not in set(base)))
    assert all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False))
    assert not any(s < e2 and s2 < e for s, e in added for _, s2, e2 in base)
    return spans


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def found(spark, texts, model):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: check(r, texts[r["doc_id"]]) for r in pii.personal_data(df, model).collect()}


def test_base_on_drawn_texts(spark, model):
    r = random.Random(3)
    parts = ["a@b.c_d@e.f", "x.y%z@q-1.co", "@", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.0255.9", "4111 1111-1111 1111", "4111111111111111", "12", "+1 (234) 555-0100", "+", "+49..", " ", "\n", "é😀", "ß", "4111111111111111 4111111111111111", ".", "-", "a"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(400)]
    texts += [None, "", "9" * 70000, "a" * 70000, "a@b" + ".c" * 30000, "😀" * 999 + " a@b.de", "1-" * 20000 + "1", " 1.2.3.4" * 3000]
    found(spark, texts, model)


def test_given_table(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in pii.personal_data(spark.read.parquet(f"{SF}/documents.parquet"), model).collect():
        check(r, texts[r["doc_id"]])


def test_what_the_trees_add(spark, model):
    texts = ['use token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "password=b7db7aa4a5fcc78305", "the 9807915762804490 4845168114407329 le", "please call (243) 555-5526 now", "write to ann.lee [at] mail7.example.com today",
             "no data at all in these plain words", "licensed, version 3.0 of 2019, page 12", "see section 12.3 and figure 4.5 of 1999-2001"]
    got = found(spark, texts, model)
    assert [{k for k, _, _ in got[i]} for i in range(2)] == [{"secret"}] * 2
    assert {k for k, _, _ in got[2]} <= {"card"}
    assert [x[0] for x in got[3]] == ["phone"] and [x[0] for x in got[4]] == ["email"]
    assert [got[i] for i in (5, 6, 7)] == [[], [], []]


def test_margin_of_column_and_of_driver(spark, model):
    trees, _ = model
    rows = [[0, 3, 10, 1, 1, 9, 3, 1, 0, 8], [2, 16, 0, 1, 0, 8, 2, 1, 0, 8], [5, 20, 12, 8, 1, 16, 3, 2, 0, 20], [3, 10, 0, 3, 1, 9, 1, 0, 1, 7]]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in rows], "f array<int>").select(pii.leaf_sum(trees, F.col("f"))).collect()]
    assert got == pytest.approx([pii.margin(trees, f) for f in rows])


def test_boosting_learns():
    table = [([k, d, 0, 0, c, 0, 0, 1, 0, 0], 50 * ((d > 5) != c), 50 * ((d > 5) == c), 5 * ((d > 5) != c), 5 * ((d > 5) == c)) for k in (0, 1) for d in range(10) for c in (0, 1)]
    trees = pii.boost(table)
    assert all((pii.margin(trees, f) > 0) == (n1 > n0) for f, n0, n1, _, _ in table)
    assert set(pii.thresholds(table, trees)) == {0, 1}
    assert pii.thresholds([([0] * 10, 1, 1, 5, 5)], trees) == {}


def test_no_examples_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(empty).count() == 0
    rows = [(None, None, 1, 2), (1, "", 1, 2), (1, "a@b.de", 1, 2), (1, "a@b.de", 1, 2), (2, "nothing", 1, 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, spans int, _base int").selectExpr("*", "1 as `a.b`", "2 as k", "3 as h")
    got = pii.personal_data(odd).collect()
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in got) == [(0, ""), (1, ""), (1, "email:0:6"), (1, "email:0:6"), (2, "")]
    kept = pii.redacted(odd)
    assert kept.columns == odd.columns and sorted(str(r["text"]) for r in kept.collect()) == ["", "<email>", "<email>", "None", "nothing"]


def test_redacted(spark, model):
    texts = ["é a@b.de, +1 (234) 555-0100; 1.2.3.4 end", "password=b7db7aa4a5fcc78305 and a@b.de"]
    got = pii.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["é <email>, <phone>; <ip> end", "<secret> and <email>"]


def test_all_spans_are_examples(spark):
    texts = [" ".join(f"{w}{i} a{i}@b{w}.de" for i in range(1000)) for w in range(21)]
    counted = pii.examples(pii.with_spans(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()
    assert sum(r.n0 + r.n1 + r.c0 + r.c1 for r in counted) == 3 * 21_000  # an address, behind other words, and with [at]
    assert sum(r.c1 for r in counted) > 3 * 4_000 and len(counted) < 500
