"""Exact quantiles of weighted values in a few passes, without all values of a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a pass, and rows of a bracket below which its values are counted one by one.
BINS, FEW = 4096, 10_000


def quantiles(rows: DataFrame, shares: tuple[float, ...], few: int = FEW) -> DataFrame:
    """(column, q0, q1, ...): interpolated quantiles of rows(column, x) or rows(column, x, n), n times x each; nulls do not count.

    Each quantile has a bracket, first the column's range.  While that holds many
    rows, a pass counts BINS equal parts of it and keeps those where the
    quantile's neighbours lie; the driver sees one row a bracket.  What is left is counted by value.
    A column without values has no row.
    """
    spark = rows.sparkSession
    rows = rows.where("x is not null").select("column", F.col("x").cast("double").alias("x"), F.col("n") if "n" in rows.columns else F.lit(1).cast("long").alias("n"))
    whole = rows.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    brackets = [{"column": r["column"], "k": k, "at": q * (r["n"] - 1), "lo": r["lo"], "hi": r["hi"], "below": 0, "rows": r["rows"]} for r in whole for k, q in enumerate(shares)]
    schema = "column string, k int, at double, lo double, hi double, below long"

    def near(some: list[dict]) -> DataFrame:
        # one row for each column of a dataset and quantile, whatever the number of records
        wanted = spark.createDataFrame([tuple(b[c.split()[0]] for c in schema.split(", ")) for b in some], schema)
        return rows.join(F.broadcast(wanted), "column").where("x between lo and hi")

    while wide := [b for b in brackets if b["rows"] > few and b["lo"] < b["hi"] and math.isfinite(b["hi"] / 2 - b["lo"] / 2)]:
        part = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        bins = near(wide).groupBy("column", "k", "at", "below", part.alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = Window.partitionBy("column", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        placed = bins.withColumn("stop", F.col("below") + F.sum("n").over(upto)).withColumn("start", F.col("stop") - F.col("n"))
        hit = placed.where("stop > floor(at) and start <= ceil(at)").groupBy("column", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("start").alias("below"), F.sum("rows").alias("rows"))
        found = {(r["column"], r["k"]): r.asDict() for r in hit.collect()}
        for b in wide:
            b |= found[b["column"], b["k"]]
    if not brackets:
        return spark.createDataFrame([], ", ".join(["column string", *[f"q{k} double" for k in range(len(shares))]]))
    counted = near(brackets).groupBy("column", "k", "at", "below", "x").agg(F.sum("n").alias("c"))
    upto = Window.partitionBy("column", "k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("stop", F.col("below") + F.sum("c").over(upto)).withColumn("start", F.col("stop") - F.col("c"))

    def value(place):
        return F.max(F.when((F.col("start") <= place) & (place < F.col("stop")), F.col("x")))

    at, low, high = F.col("at"), F.floor("at"), F.ceil("at")
    found = placed.groupBy("column", "k", "at").agg(value(low).alias("a"), value(high).alias("b"))
    between = F.when(low == high, F.col("a")).otherwise((high - at) * F.col("a") + (at - low) * F.col("b"))
    sure = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(between)
    return found.groupBy("column").agg(*[F.max(F.when(F.col("k") == k, sure)).alias(f"q{k}") for k in range(len(shares))])
