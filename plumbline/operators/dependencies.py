"""Which columns determine which: a level-wise search through sets of columns, with the share of rows that break a dependency.

A set of columns X cuts the rows where it is present into groups; X determines A
as far as most rows of each group hold the same A.  The error is the least share of rows
to leave out so that it holds everywhere (g3): one less the sum of each group's most
frequent A.  Sets grow by one column a level.  Left out, with nothing lost:

* groups of one row break nothing: sets whose groups all have one row (keys) are not extended,
  and sets with too many groups for their rows determine everything and tell nothing;
* what a smaller set determines already is not asked of a larger one (dependencies are minimal);
* A with more values than X has groups, plus the rows that may break it, cannot be determined;
* a column with one value is determined by anything.

Each level is two aggregations with map-side combine, over rows repeated for BATCH
candidates at a time; the driver sees a few numbers for each candidate.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..shared import small_side, written

ROW = "__row__"
SEPARATOR = "\x1f"
BATCH = 48
FOUND = "determinants string, dependent string, evaluated long, groups long, violations long"


@dataclass(frozen=True)
class Dependency:
    """Rows where all its columns are present, groups of the determinants among them, and rows to leave out so that it holds."""

    determinants: tuple[str, ...]
    dependent: str
    evaluated: int
    groups: int
    violations: int

    @property
    def error(self) -> float:
        return self.violations / self.evaluated if self.evaluated else 0.0


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row, c0, c1, ...): lower-case stripped values, null where absent."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    return df.select(F.col(ROW).alias("row"), *[F.when(X.present(t), F.lower(X.trimmed(t))).alias(f"c{k}") for k, t in enumerate(text)])


def key_of(places: Sequence[int]) -> Column:
    """The values of some columns as one, null where one is absent; their lengths keep them apart."""
    c = [F.col(f"c{k}") for k in places]
    return c[0] if len(c) == 1 else F.concat(*[f for x in c for f in (F.length(x).cast("string"), F.lit(SEPARATOR), x)])


def group_counts(rows: DataFrame, sets: list[tuple[int, ...]]) -> dict[tuple[int, ...], tuple[int, int]]:
    """(groups, rows) of each set, over the rows where it is present."""
    out = {}
    for part in itertools.batched(sets, BATCH):
        made = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), key_of(s).alias("k")) for i, s in enumerate(part)]))
        keys = rows.select(made.alias("x")).where("x.k is not null").groupBy("x.s", "x.k").agg(F.count("*").alias("n"))
        got = {r["s"]: (r["g"], r["n"]) for r in keys.groupBy("s").agg(F.count("*").alias("g"), F.sum("n").alias("n")).collect()}
        out |= {s: got.get(i, (0, 0)) for i, s in enumerate(part)}
    return out


def measured(rows: DataFrame, candidates: list[tuple[tuple[int, ...], int]], names: Sequence[str]) -> dict[tuple[tuple[int, ...], int], Dependency]:
    """The counts of each candidate (set, dependent)."""
    out = {}
    for part in itertools.batched(candidates, BATCH):
        made = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), key_of(s).alias("k"), F.col(f"c{a}").alias("v")) for i, (s, a) in enumerate(part)]))
        pairs = rows.select(made.alias("x")).where("x.k is not null and x.v is not null").groupBy("x.s", "x.k", "x.v").agg(F.count("*").alias("n"))
        groups = pairs.groupBy("s", "k").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
        for r in groups.groupBy("s").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") - F.col("most")).alias("bad")).collect():
            s, a = part[r["s"]]
            out[s, a] = Dependency(tuple(names[k] for k in s), names[a], r["n"], r["g"], r["bad"])
    return out


def search(df: DataFrame, columns: Sequence[str], max_size: int = 2, error: float = 1 - config.FD_CONSISTENCY, min_groups: int = config.FD_MIN_GROUPS, max_ratio: float = config.FD_MAX_RATIO) -> list[Dependency]:
    """All minimal dependencies among the columns of a dataset with ``__row__``, by size and then in column order.

    Of determinants with at most ``max_size`` columns, at least ``min_groups`` groups and at most
    ``max_ratio`` groups a row, those that all but a share ``error`` of the rows keep.  No
    pair is left out for its number.
    """
    rows = written(cells(df, columns), "cells")
    single = group_counts(rows, [(k,) for k in range(len(columns))])
    values = {k: single[k,][0] for k in range(len(columns))}
    known, found, level = dict(single), [], sorted(single)
    settled: set[tuple[frozenset[int], int]] = set()
    for size in range(1, max_size + 1):
        if size > 1:
            grown = sorted({tuple(sorted({*s, k})) for s in level for k in range(len(columns)) if k not in s and 0 < values[k]})
            whole = [s for s in grown if all(known.get(tuple(sorted(set(s) - {k})), (0, 1))[0] < known.get(tuple(sorted(set(s) - {k})), (0, 1))[1] for k in s)]
            known |= group_counts(rows, whole)
            level = whole
        level = [s for s in level if 0 < known[s][0] < known[s][1]]
        candidates = []
        for s in level:
            groups, n = known[s]
            # the bounds hold for the rows where the dependent is present too: they can only have fewer groups
            if groups < max(2, min_groups):
                continue
            for a in range(len(columns)):
                if a in s or values[a] < 2 or any((frozenset(t), a) in settled for r in range(1, size) for t in itertools.combinations(s, r)):
                    continue
                candidates.append((s, a))
        got = measured(rows, [c for c in candidates if values[c[1]] <= known[c[0]][0] + error * known[c[0]][1] or missing(single, c[1], known[c[0]][1])], columns)
        for (s, a), d in sorted(got.items()):
            if d.groups >= min_groups and d.groups <= max_ratio * d.evaluated and d.violations <= error * d.evaluated:
                found.append(d)
                settled.add((frozenset(s), a))
    return found


def missing(single: dict[tuple[int, ...], tuple[int, int]], a: int, rows: int) -> bool:
    """Whether the dependent is present in more rows than the set, so that its values there may be fewer."""
    return single[a,][1] > rows


def frame(df: DataFrame, found: list[Dependency]) -> DataFrame:
    return df.sparkSession.createDataFrame([(", ".join(d.determinants), d.dependent, d.evaluated, d.groups, d.violations) for d in found], FOUND)


def contradictions(df: DataFrame, found: list[Dependency]) -> DataFrame:
    """(determinants, dependent, row, key, value, usual): the rows whose value is not the most frequent one of their group.

    Ties go to the least value.  The usual values are joined back, sent to all where they are few.
    """
    columns = sorted({c for d in found for c in (*d.determinants, d.dependent)})
    if not found:
        return df.sparkSession.createDataFrame([], "determinants string, dependent string, row long, key string, value string, usual string")
    rows, at = cells(df, columns), {c: k for k, c in enumerate(columns)}
    made = F.array(*[F.struct(F.lit(", ".join(d.determinants)).alias("determinants"), F.lit(d.dependent).alias("dependent"), key_of([at[c] for c in d.determinants]).alias("k"), F.concat_ws(", ", *[f"c{at[c]}" for c in d.determinants]).alias("key"), F.col(f"c{at[d.dependent]}").alias("value")) for d in found])
    long = rows.select("row", F.explode(made).alias("x")).select("x.*", "row").where("k is not null and value is not null")
    counts = long.groupBy("determinants", "dependent", "k", "value").agg(F.count("*").alias("n"))
    usual = written(counts.groupBy("determinants", "dependent", "k").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("usual")), "usual")
    return long.join(small_side(usual, 120), ["determinants", "dependent", "k"]).where("value <> usual").select("determinants", "dependent", "row", "key", "value", "usual")
