"""Counters and first examples of one pass against sorting all rows."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import onepass


@pytest.mark.parametrize("merged", [64, 2])
def test_counts_and_first_rows(spark, monkeypatch, merged):
    monkeypatch.setattr(onepass, "MERGED", merged)
    r = random.Random(merged)
    rows = [(k, r.choice([None, "a", "b", "c"]), r.randrange(10)) for k in r.sample(range(100000), 3000)]
    df = spark.createDataFrame(rows, "__row__ long, x string, y int").repartition(7)
    rules = [
        (F.col("x").isNotNull(), F.col("x") == "b", F.col("x"), F.lit("is b")),
        (F.lit(True), F.col("y") > 7, F.col("y"), F.concat(F.lit("y is "), F.col("y").cast("string"))),
        (F.col("y") == 3, F.lit(None).cast("boolean"), F.col("x"), F.lit("never")),
        (F.lit(False), F.lit(True), F.col("x"), F.lit("none")),
    ]
    got = onepass.counted_with_examples(df, rules, 20).collect()
    plain = [(lambda x, y: x is not None, lambda x, y: x == "b", 1), (lambda x, y: True, lambda x, y: y > 7, 2), (lambda x, y: y == 3, lambda x, y: False, 1), (lambda x, y: False, lambda x, y: True, 1)]
    for k, (asked, bad, at) in enumerate(plain):
        for failed in (False, True):
            own = sorted(row for row in rows if asked(*row[1:]) and bad(*row[1:]) == failed)
            assert sum(g["n"] for g in got if (g["rule"], g["failed"]) == (k, failed) and g["n"] is not None) == len(own)
            found = sorted((g["row"], g["value"]) for g in got if (g["rule"], g["failed"]) == (k, failed) and g["row"] is not None)
            assert found == [(row[0], None if row[at] is None else str(row[at])) for row in own[:20]]
    reasons = {g["reason"] for g in got if g["rule"] == 1 and g["failed"] and g["row"] is not None}
    assert reasons == {"y is 8", "y is 9"} and all(g["reason"] is None for g in got if not g["failed"])


def test_no_rows_or_rules(spark):
    df = spark.createDataFrame([], "__row__ long, x string")
    assert onepass.counted_with_examples(df, []).count() == 0
    assert sum(r["n"] or 0 for r in onepass.counted_with_examples(df, [(F.lit(True), F.lit(True), F.col("x"), F.lit(""))]).collect()) == 0
