"""Profiles: one row of statistics for each column of a dataset.

The dataset is unpivoted to (column, __row__, value) and counted once by value:
the histogram.  Counts, lengths, rates of types and meanings, numbers, top values and
masks all follow from it, so that a pattern or a date is tried once a value and
not once a cell, and histograms of parts of a dataset can be added up.  Nothing
depends on chunks: statistics cover all rows.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..shared import written
from .quantiles import quantiles

ROW = "__row__"
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "t", "f", "1", "0")


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, __row__, raw, v): one row for each cell; v is stripped."""
    columns = columns or [c for c in df.columns if c != ROW]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("raw")) for c in columns])
    return df.select(ROW, F.explode(cells).alias("c")).select("c.column", ROW, "c.raw", X.strip(F.col("c.raw")).alias("v"))


def histogram(cells: DataFrame) -> DataFrame:
    """(column, v, n, __row__): how often each value of a column occurs, and where first; null and blank are values here."""
    return cells.groupBy("column", "v").agg(F.count("*").alias("n"), F.min(ROW).alias(ROW))


def added(histograms: DataFrame) -> DataFrame:
    """Histograms of parts of a dataset, one below the other, as that of the whole."""
    return histograms.groupBy("column", "v").agg(F.sum("n").alias("n"), F.min(ROW).alias(ROW))


def by_value(cells: DataFrame) -> DataFrame:
    """Cells as a histogram, unless they are one."""
    return cells if "n" in cells.columns else histogram(cells)


FULL = "v is not null and v <> ''"


def weight(cond=None):
    """The sum of the counts of values (that meet a condition)."""
    return F.coalesce(F.sum(F.col("n") if cond is None else F.when(cond, F.col("n"))), F.lit(0))


def counts(cells: DataFrame) -> DataFrame:
    """Per column counts, lengths, least and greatest value."""
    v = F.col("v")
    full = v.isNotNull() & (v != "")
    populated = F.col("populated")
    basic = by_value(cells).groupBy("column").agg(
        weight().alias("total"),
        weight(v.isNull()).alias("nulls"),
        weight(v == "").alias("blanks"),
        weight(full & X.is_placeholder(v)).alias("placeholders"),
        weight(full).alias("populated"),
        F.count_if(full).alias("distinct"),
        F.coalesce(F.min(F.when(full, F.length(v))), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(F.when(full, F.length(v))), F.lit(0)).alias("max_length"),
        F.coalesce(F.sum(F.when(full, F.length(v) * F.col("n"))) / F.sum(F.when(full, F.col("n"))), F.lit(0.0)).alias("mean_length"),
        F.min(F.when(full, v)).alias("min_value"),
        F.max(F.when(full, v)).alias("max_value"),
    )
    return basic.withColumns({
        "fill_rate": F.when(F.col("total") > 0, populated / F.col("total")).otherwise(F.lit(0.0)),
        "distinct_ratio": F.when(populated > 0, F.least(F.col("distinct") / populated, F.lit(1.0))).otherwise(F.lit(0.0)),
    })


def number_of(v):
    """A value as a number, without separators and currency signs; null where it is none."""
    clean = F.regexp_replace(F.regexp_replace(v, "[, ]", ""), r"^[$€£₹]+", "")
    return F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean.cast("double"))


def numbers(cells: DataFrame) -> DataFrame:
    """(column, num_min, num_max, num_mean, num_median, mad, negatives) over values that read as numbers; other columns have no row."""
    read = by_value(cells).where(FULL).select("column", number_of(F.col("v")).alias("x"), "n").where("x is not null")
    part = written(read.groupBy("column", "x").agg(F.sum("n").alias("n")), "numbers")
    found = part.groupBy("column").agg(F.min("x").alias("num_min"), F.max("x").alias("num_max"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("num_mean"), weight(F.col("x") < 0).alias("negatives"))
    middle = written(quantiles(part, (0.5,)).withColumnRenamed("q0", "num_median"), "medians")
    apart = part.join(F.broadcast(middle), "column").select("column", F.abs(F.col("x") - F.col("num_median")).alias("x"), "n")
    return found.join(middle, "column", "left").join(quantiles(apart, (0.5,)).withColumnRenamed("q0", "mad"), "column", "left")


def rates(cells: DataFrame) -> DataFrame:
    """(column, date_parse_rate, has_time, rates of types and meanings) over populated cells."""
    v = F.col("v")
    day = by_value(cells).where(FULL).select("column", "v", "n", X.date(v).isNotNull().alias("day"))

    def share(cond):
        return weight(cond) / F.sum("n")

    enough = F.length(F.regexp_replace(v, r"\D", "")) >= 7
    types = day.groupBy("column").agg(
        share(F.lower(v).isin(*BOOLEANS)).alias("rate_boolean"),
        share(v.isin("0", "1")).alias("rate_bits"),
        share(v.rlike(r"^-?[\d,]+$") & clean_is_integer(v)).alias("rate_integer"),
        share(number_of(v).isNotNull()).alias("rate_decimal"),
        share(F.col("day")).alias("date_parse_rate"),
        F.bool_or(v.rlike(r"\d{1,2}:\d{2}")).alias("has_time"),
    )
    meanings = day.groupBy("column").agg(*[share(v.rlike(p) & enough if name == "phone" else v.rlike(p)).alias(f"rate_{name}") for name, p in config.SEMANTIC_VALUES])
    return types.join(meanings, "column")


def inferred_type(c: dict[str, Any]) -> str:
    """P10 from a column's rates."""
    if not c["populated"]:
        return "string"
    if c["rate_boolean"] >= config.TYPE_AGREEMENT and c["rate_bits"] < 1:
        return "boolean"
    for kind, rate in (("integer", "rate_integer"), ("decimal", "rate_decimal")):
        if c[rate] >= config.TYPE_AGREEMENT:
            return kind
    if c["date_parse_rate"] >= config.TYPE_AGREEMENT:
        return "datetime" if c["has_time"] else "date"
    return "string"


def clean_is_integer(v):
    return F.regexp_replace(v, "[, -]", "").rlike(r"^\d+$")


def top(cells: DataFrame, key, n: int) -> DataFrame:
    """(column, key, n, first_row, rank) of the n most frequent keys; ties by first occurrence."""
    grouped = by_value(cells).where(FULL).groupBy("column", key.alias("key")).agg(F.sum("n").alias("n"), F.min(ROW).alias("first_row"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "first_row")
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def samples(cells: DataFrame, n: int = config.SAMPLE_VALUES) -> DataFrame:
    """The first n values of each column in row order."""
    order = Window.partitionBy("column").orderBy(ROW)
    return cells.where(FULL).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("column", "rank", "v", ROW)


def enum_domains(top_values: DataFrame, statistics: DataFrame, coverage: float = config.ENUM_COVERAGE) -> DataFrame:
    """(column, key, rank): the most frequent values until their share reaches the coverage, of columns with few values."""
    before = Window.partitionBy("column").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    few = statistics.where((F.col("distinct") > 0) & (F.col("distinct") <= config.ENUM_MAX)).select("column")
    ranked = top_values.join(few, "column", "left_semi").withColumns({"_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "_all": F.sum("n").over(whole)})
    return ranked.where(F.col("_before") / F.col("_all") < coverage).select("column", "key", "rank")


def meaning_of_name(name: str) -> str | None:
    return next((m for m, p in config.SEMANTIC_NAMES if re.search(p, name.strip().lower())), None)


def meaning(name: str, rates: dict[str, float], inferred: str) -> tuple[str, float, bool]:
    """(meaning, confidence, whether name and values disagree)."""
    by_name, best, rate = meaning_of_name(name), None, 0.0
    for m, _ in config.SEMANTIC_VALUES:
        if rates[m] > rate:
            best, rate = m, rates[m]
    by_value = best if rate >= config.SEMANTIC_MATCH else None
    if by_name:
        if by_name == by_value:
            return by_name, max(rate, 0.9), False
        if by_name in config.UNVERIFIABLE:
            odd = by_name in ("date", "datetime") and inferred not in ("date", "datetime")
            return by_name, 0.5 if odd else 0.75, odd
        if by_name not in rates:
            return by_name, 0.0 if by_value else 0.7, bool(by_value)
        return by_name, rates[by_name], rates[by_name] < config.SEMANTIC_MATCH
    if by_value:
        return by_value, rate, False
    return {"integer": ("amount", 0.3, False), "decimal": ("amount", 0.3, False), "date": ("date", 0.8, False), "datetime": ("datetime", 0.8, False), "boolean": ("boolean_flag", 0.8, False)}.get(inferred, ("free_text", 0.0, False))


def cde_score(c: dict[str, Any], rows: int) -> tuple[float, list[str]]:
    """How likely a column is a critical data element, and why."""
    if not c["populated"]:
        return 0.0, ["empty"]
    score, why = 0.0, []

    def add(weight: float, reason: str) -> None:
        nonlocal score
        score += weight
        why.append(reason)

    name = c["column"].strip()
    if any(re.search(p, name, re.I) for p in config.METADATA_NAMES):
        add(config.CDE_METADATA_NAME, "technical name")
    elif any(re.search(p, name, re.I) for p in config.BUSINESS_NAMES):
        add(config.CDE_BUSINESS_NAME, "business name")
    if c["semantic_type"] in config.BUSINESS_MEANINGS:
        add(config.CDE_SEMANTIC, f"means {c['semantic_type']}")
    if 0.2 <= c["fill_rate"] <= 1:
        add(config.CDE_FILL, "filled")
    if c["distinct"] == 1:
        add(config.CDE_SINGLE, "one value only")
    elif c["distinct_ratio"] >= 0.9 and c["inferred_type"] == "string":
        add(config.CDE_DISTINCT, "distinct values")
    elif rows > 1000 and c["distinct_ratio"] < 0.001:
        add(config.CDE_FEW, "few values")
    return max(0.0, min(1.0, score)), why


def mark_cdes(columns: list[dict[str, Any]], rows: int, override: list[str] | None = None) -> list[str]:
    """Set cde_score, cde_reasons and is_cde; the unknown names of an override are returned."""
    for c in columns:
        c["cde_score"], c["cde_reasons"] = cde_score(c, rows)
        c["is_cde"] = c["cde_score"] >= config.CDE_THRESHOLD
    if not any(c["is_cde"] for c in columns):
        filled = sorted((c for c in columns if c["populated"]), key=lambda c: -c["cde_score"])
        for c in filled[: max(1, len(columns) // 3)]:
            c["is_cde"] = True
            c["cde_reasons"].append("among the highest")
    if override is None:
        return []
    chosen = set(override)
    for c in columns:
        if c["is_cde"] != (c["column"] in chosen):
            c["cde_reasons"] = ["chosen"] if c["column"] in chosen else ["not chosen"]
        c["is_cde"] = c["column"] in chosen
    return sorted(chosen - {c["column"] for c in columns})


def profile(df: DataFrame, override: list[str] | None = None) -> list[dict[str, Any]]:
    """The profile of a dataset with ``__row__``, in column order: a few dozen values for each column, on the driver."""
    names = [c for c in df.columns if c != ROW]
    cells = long_form(df, names)
    return profile_of(written(histogram(cells), "histogram"), names, samples(cells), override)


def profile_of(cells: DataFrame, names: list[str], first_values: DataFrame, override: list[str] | None = None) -> list[dict[str, Any]]:
    """The profile that a histogram and the first values (``samples``) give."""
    statistics: dict[str, dict] = {n: {} for n in names}
    for part in (counts(cells), numbers(cells), rates(cells)):
        for r in part.collect():
            statistics[r["column"]] |= r.asDict()
    values, masks, firsts = (defaults(names) for _ in range(3))
    for r in top(cells, F.col("v"), config.TOP_VALUES).orderBy("column", "rank").collect():
        values[r["column"]].append((r["key"], r["n"]))
    for r in top(cells, X.mask(F.col("v")), config.TOP_MASKS).orderBy("column", "rank").collect():
        masks[r["column"]].append((r["key"], r["n"]))
    for r in first_values.orderBy("column", "rank").collect():
        firsts[r["column"]].append(r["v"])
    out, rows = [], 0
    for name in names:
        c = {k: v for k, v in statistics[name].items() if v is not None}
        c = empty(name) | c
        c["inferred_type"] = inferred_type(c)
        rows = max(rows, c["total"])
        shares = {m: c.pop(f"rate_{m}", 0.0) for m, _ in config.SEMANTIC_VALUES}
        c["semantic_type"], c["semantic_confidence"], c["name_value_conflict"] = meaning(name, shares, c["inferred_type"])
        c |= {"top_values": values[name], "pattern_masks": masks[name], "sample_values": firsts[name], "enum_domain": []}
        if 0 < c["distinct"] <= config.ENUM_MAX and c["semantic_type"] not in config.OPEN_ENDED:
            total, run = sum(n for _, n in values[name]), 0
            for v, n in values[name]:
                if run / total >= config.ENUM_COVERAGE:
                    break
                c["enum_domain"].append(v)
                run += n
        out.append(c)
    if unknown := mark_cdes(out, rows, override):
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return out


def defaults(names: list[str]) -> dict[str, list]:
    return {n: [] for n in names}


def empty(name: str) -> dict[str, Any]:
    """The statistics of a column without rows."""
    zero = ("total", "nulls", "blanks", "placeholders", "populated", "distinct", "min_length", "max_length", "negatives")
    rates = ("mean_length", "rate_boolean", "rate_bits", "rate_integer", "rate_decimal", "date_parse_rate", "fill_rate", "distinct_ratio")
    none = ("min_value", "max_value", "num_min", "num_max", "num_mean", "num_median", "mad")
    return {"column": name, "inferred_type": "string", "has_time": False} | dict.fromkeys(zero, 0) | dict.fromkeys(rates, 0.0) | dict.fromkeys(none)
