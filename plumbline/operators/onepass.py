"""Counters and first examples of many rules from one pass over the rows.

Spark evaluates the rules as columns; a task then counts, and keeps for each rule the
``cap`` violations and valid rows with the smallest row numbers.  Tasks' lists meet in
a few merges that keep as many again, so that no rule's rows are ever sorted or gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..shared import written

ROW = "__row__"
#: Lists of tasks that meet in one merge.
MERGED = 64
SCHEMA = "rule int, failed boolean, row long, value string, reason string, n long"


class Smallest:
    """The ``cap`` smallest rows seen, with their texts, in any order."""

    def __init__(self, cap: int):
        self.cap, self.rows, self.texts = cap, np.zeros(0, np.int64), []

    def add(self, rows: np.ndarray, texts) -> None:
        """rows, and a function that gives the texts of some of their places."""
        if len(self.rows) == self.cap:
            fit = np.flatnonzero(rows < self.rows.max())
        else:
            fit = np.arange(len(rows))
        if not len(fit):
            return
        if len(fit) > self.cap:
            fit = fit[np.argpartition(rows[fit], self.cap - 1)[: self.cap]]
        together = np.concatenate([self.rows, rows[fit]])
        own = [*self.texts, *texts(fit)]
        if len(together) > self.cap:
            keep = np.argpartition(together, self.cap - 1)[: self.cap]
            together, own = together[keep], [own[k] for k in keep]
        self.rows, self.texts = together, own


def counted_with_examples(df: DataFrame, rules: list[tuple[Column, Column, Column, Column]], cap: int = config.EXAMPLE_CAP) -> DataFrame:
    """(rule, failed, row, value, reason, n) for rules (evaluated, failed, shown value, reason) of a dataset with ``__row__``.

    For each rule and outcome: one row with ``n``, how many rows have it (row null), and the first ``cap`` of them
    in row order (n null), the reason for failed ones only.  ``rule`` is the place in the list.
    """
    if not rules:
        return df.sparkSession.createDataFrame([], SCHEMA)
    state = [F.when(e, F.coalesce(f, F.lit(False)).cast("tinyint")).otherwise(F.lit(2).cast("tinyint")).alias(f"s{k}") for k, (e, f, _, _) in enumerate(rules)]
    # equal values are shown once, whatever the number of rules over them
    shown, places = {}, []
    for _, _, v, w in rules:
        places.append(tuple(shown.setdefault(str(c), (len(shown), c))[0] for c in (v, w)))
    table = df.select(F.col(ROW).alias("row"), *state, *[c.cast("string").alias(f"t{k}") for k, c in shown.values()])

    count = len(rules)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((count, 2), np.int64)
        lists = [[Smallest(cap), Smallest(cap)] for _ in range(count)]
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            for k, (v, w) in enumerate(places):
                own = batch.column(f"s{k}").to_numpy(zero_copy_only=False)
                for failed in (0, 1):
                    at = np.flatnonzero(own == failed)
                    counts[k, failed] += len(at)
                    if len(at):
                        lists[k][failed].add(rows[at], lambda fit, at=at, v=v, w=w: list(zip(batch.column(f"t{v}").take(pa.array(at[fit])).to_pylist(), batch.column(f"t{w}").take(pa.array(at[fit])).to_pylist(), strict=True)))  # noqa: B023
        out = [(k, bool(f), None, None, None, int(counts[k, f])) for k in range(count) for f in (0, 1)]
        out += [(k, bool(f), int(r), v, w if f else None, None) for k in range(count) for f in (0, 1) for r, (v, w) in zip(lists[k][f].rows, lists[k][f].texts, strict=True)]
        yield batch_of(out)

    def merge(parts: pa.Table) -> pa.Table:
        counts: dict[tuple, int] = {}
        kept: dict[tuple, Smallest] = {}
        for rule, failed in set(zip(parts.column("rule").to_pylist(), parts.column("failed").to_pylist(), strict=True)):
            own = parts.filter(pa.compute.and_(pa.compute.equal(parts.column("rule"), rule), pa.compute.equal(parts.column("failed"), failed)))
            counts[rule, failed] = sum(n for n in own.column("n").to_pylist() if n is not None)
            some = own.filter(pa.compute.is_valid(own.column("row")))
            kept[rule, failed] = Smallest(cap)
            if some.num_rows:
                texts = list(zip(some.column("value").to_pylist(), some.column("reason").to_pylist(), strict=True))
                kept[rule, failed].add(some.column("row").to_numpy(), lambda fit, texts=texts: [texts[k] for k in fit])
        out = [(*key, None, None, None, n) for key, n in counts.items()]
        out += [(*key, int(r), *t, None) for key, s in kept.items() for r, t in zip(s.rows, s.texts, strict=True)]
        return pa.Table.from_batches([batch_of(out)])

    parts = written(table.mapInArrow(take, SCHEMA).withColumn("part", F.spark_partition_id()), "examples")
    lists = parts.agg(F.max("part")).first()[0] or 0
    while lists >= MERGED:
        # by rule too, so that a merge holds at most MERGED lists of one outcome of one rule
        parts = parts.withColumn("part", F.expr(f"part div {MERGED}"))
        parts = written(parts.groupBy("rule", "failed", "part").applyInArrow(lambda key, t: with_part(merge(t), key[2].as_py()), f"{SCHEMA}, part int"), "examples")
        lists //= MERGED
    return parts.groupBy("rule", "failed").applyInArrow(lambda key, t: merge(t), SCHEMA)


def with_part(table: pa.Table, part: int) -> pa.Table:
    return table.append_column("part", pa.array([part] * table.num_rows, pa.int32()))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["rule", "failed", "row", "value", "reason", "n"])
