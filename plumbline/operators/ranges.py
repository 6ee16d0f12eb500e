"""Joins of values with ranges that come as data, without comparing every value with every range.

A range of whole numbers is cut into blocks whose length is a power of two and
which begin at a multiple of it: at most two for each power.  A value lies in one block
of each length.  So a join on (length, block) finds each pair of a value and a range that holds
it exactly once, whatever the lengths, and no pair has to be checked again.  Values
are repeated for the lengths that occur only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import small_side, written

#: Powers of two that lengths may have: whole numbers from -2**61 on and below 2**61.
POWERS = 63
SHIFT = 1 << 61


def blocks(low: Column, high: Column) -> Column:
    """The blocks (p, b) of the range low..high (both included, from -2**61 and below 2**61); none where high < low."""

    def at(p: Column) -> Column:
        # least multiple of 2**p from low on, and greatest up to high + 1, in units of 2**p
        first = -F.call_function("shiftright", -(low + SHIFT), p)
        last = F.call_function("shiftright", high + SHIFT + 1, p)
        odd = first % 2 != 0
        left = F.when(odd & (first < last), F.struct(p.alias("p"), first.alias("b")))
        after = first + F.when(odd, 1).otherwise(0)
        right = F.when((last % 2 != 0) & (after < last), F.struct(p.alias("p"), (last - 1).alias("b")))
        return F.array_compact(F.array(left, right))

    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(POWERS - 1)), at))
    return F.when(low <= high, cut).otherwise(F.array().cast("array<struct<p:int,b:bigint>>"))


def in_ranges(values: DataFrame, ranges: DataFrame, value: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """values joined with ranges on ``value between low and high``, for whole numbers from -2**61 and below 2**61.

    ``how``: inner, or left_semi and left_anti for values that lie in some range or in none.
    Null values and null ends match nothing.  Columns of both sides stay; their names must differ.
    """
    names = values.columns
    cut = written(ranges.withColumn("_block", F.explode(blocks(F.col(low).cast("long"), F.col(high).cast("long")))).selectExpr(*[f"`{c}`" for c in ranges.columns], "_block.p as _p", "_block.b as _b"), "ranges")
    powers = sorted(r["_p"] for r in cut.select("_p").distinct().collect())
    if not powers:
        return values if how == "left_anti" else values.limit(0) if how == "left_semi" else values.limit(0).crossJoin(ranges.limit(0))
    x = F.col(value).cast("long")
    places = F.array(*[F.struct(F.lit(p).alias("p"), F.shiftright(x + SHIFT, p).alias("b")) for p in powers])
    right = small_side(cut, 24 + 16 * len(ranges.columns))
    if how == "inner":
        spread = values.withColumn("_place", F.explode(F.when(x.isNotNull(), places))).selectExpr(*[f"`{c}`" for c in names], "_place.p as _p", "_place.b as _b")
        return spread.join(right, ["_p", "_b"]).drop("_p", "_b")
    distinct = values.select(x.alias("_x")).where("_x is not null").distinct()
    own = F.array(*[F.struct(F.lit(p).alias("p"), F.shiftright(F.col("_x") + SHIFT, p).alias("b")) for p in powers])
    hit = distinct.select("_x", F.explode(own).alias("_place")).selectExpr("_x", "_place.p as _p", "_place.b as _b").join(right.select("_p", "_b"), ["_p", "_b"], "left_semi").select("_x").distinct()
    return values.join(hit, x == F.col("_x"), how)
