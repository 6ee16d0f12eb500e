"""Assessing a stream: the counters of bound rules, kept up to date batch by batch.

Rules are bound against a profile made before (of a first batch or a stored
one); each micro-batch then adds its counts.  A batch that is replayed after a
failure replaces its own counts, so nothing counts twice.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import Context
from ..plans.assess import cell_counts, outcomes, prepared
from ..plans.rules import Rule, bind, default_pack

SCHEMA = "batch long, rule_id string, dimension string, severity string, column string, evaluated long, failed long"


def batch_counts(df: DataFrame, profile: list[dict[str, Any]], as_of: datetime, rules: list[Rule] | None = None) -> list[tuple]:
    """(rule_id, dimension, severity, column, evaluated, failed) of every bound cell rule over one batch."""
    context = Context(prepared(df, profile), profile, as_of)
    bound = outcomes(bind(rules or default_pack(), profile), context, {})
    df = context.df
    return [(r.id, r.dimension, r.severity, r.column, e, f) for (r, _), (e, f) in zip(bound, cell_counts(df, bound), strict=True)]


def count_stream(stream: DataFrame, profile: list[dict[str, Any]], as_of: datetime, path: str, checkpoint: str, rules: list[Rule] | None = None) -> StreamingQuery:
    """Write each micro-batch's counts below ``path`` until the stream's data are used up."""

    def keep(df: DataFrame, batch: int) -> None:
        rows = [(batch, *r) for r in batch_counts(df, profile, as_of, rules)]
        df.sparkSession.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/b{batch:012d}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The counters over all batches so far: what a batch assessment of the same rows counts."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/b*")
    return rows.groupBy("rule_id", "dimension", "severity", "column").agg(F.sum("evaluated").alias("evaluated"), F.sum("failed").alias("failed"))
