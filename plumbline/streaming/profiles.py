"""The profile of a stream: histograms of its batches, added up.

What each micro-batch leaves is its histogram (column, value, count, first row)
and its first values; both can be added to those of any other rows, so the profile
of all batches equals that of one batch with all rows, however they were split. Batches write
under their number and are named in a manifest once complete: one that is replayed after a failure
replaces itself, one that broke off is not read.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..operators import profile as profiles
from ..shared import commit, committed, written

ROW = "__row__"


def keep_batch(df: DataFrame, batch: int, path: str) -> None:
    """Adds a batch's histogram and first values to the state below ``path``, in place of an earlier try of the same batch."""
    spark = df.sparkSession
    cells = profiles.long_form(df)
    name = f"b{batch:012d}"
    profiles.histogram(cells).write.mode("overwrite").parquet(f"{path}/{name}/values")
    profiles.samples(cells).write.mode("overwrite").parquet(f"{path}/{name}/first")
    state = committed(spark, path) or {"parts": [], "batches": [], "columns": [c for c in df.columns if c != ROW]}
    if batch not in state["batches"]:
        commit(spark, path, state | {"parts": [*state["parts"], name], "batches": [*state["batches"], batch]})


def profile_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of a stream of rows with ``__row__`` until its data are used up; start it again to go on."""
    return stream.writeStream.foreachBatch(lambda df, batch: keep_batch(df, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_of(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, DataFrame]:
    """(columns, histogram, first values) of all complete batches."""
    state = committed(spark, path)
    if state is None:
        raise ValueError("no batch is complete")
    values = spark.read.parquet(*[f"{path}/{p}/values" for p in state["parts"]])
    first = spark.read.parquet(*[f"{path}/{p}/first" for p in state["parts"]])
    order = Window.partitionBy("column").orderBy(ROW)
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.SAMPLE_VALUES)
    return state["columns"], profiles.added(values), first


def profile_so_far(spark: SparkSession, path: str, override: list[str] | None = None) -> list[dict[str, Any]]:
    """What ``profile`` gives for all rows of the complete batches."""
    names, values, first = state_of(spark, path)
    return profiles.profile_of(written(values, "histogram"), names, first, override)


def compact(spark: SparkSession, path: str) -> None:
    """Adds all parts up into one, so that the state does not grow with the number of batches; later batches go on."""
    state = committed(spark, path)
    if state is None or len(state["parts"]) < 2:
        return
    _, values, first = state_of(spark, path)
    name = f"sum-{state['batches'][-1]:012d}-{len(state['batches'])}"
    values.write.mode("overwrite").parquet(f"{path}/{name}/values")
    first.write.mode("overwrite").parquet(f"{path}/{name}/first")
    commit(spark, path, state | {"parts": [name]})
