"""Views of assessments: profiles and runs as tables, searching, several datasets confirmed together."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as profiles
from .assess import Assessment, assess, pool

PROFILE = "column string, inferred_type string, semantic_type string, semantic_confidence double, name_value_conflict boolean, total long, nulls long, blanks long, placeholders long, populated long, fill_rate double, distinct long, distinct_ratio double, min_length int, max_length int, mean_length double, min_value string, max_value string, cde_score double, is_cde boolean, cde_reasons array<string>, sample_values array<string>, enum_domain array<string>, top_values array<struct<value:string,n:bigint>>, pattern_masks array<struct<value:string,n:bigint>>"


def profile_view(spark: SparkSession, profile: list[dict[str, Any]]) -> DataFrame:
    """A profile as one row for each column."""
    names = [f.split()[0] for f in PROFILE.split(", ")]
    return spark.createDataFrame([tuple(c[n] for n in names) for c in profile], PROFILE)


def run_view(runs: DataFrame) -> DataFrame:
    """What each run shows by its status: counts once profiled, scores once completed, a message once failed."""
    status = F.col("status")
    known = status.isin("awaiting_cdes", "completed")
    return runs.select("run_id", "status", *[F.when(known, F.col(c)).alias(c) for c in ("records", "columns", "cdes")], F.when(status == "completed", F.col("overall")).alias("overall"), F.when(status == "failed", F.col("error")).alias("error"))


def search(names: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows one of whose columns contains a text, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.strip().lower()))
    return names.where(F.coalesce(hit, F.lit(False)))


def dimensions_in_order(scores: DataFrame) -> DataFrame:
    """O2: dimensions from the lowest score up, those not assessed last."""
    return scores.orderBy(F.asc_nulls_last("score"), "dimension")


def profile_all(datasets: dict[str, DataFrame]) -> dict[str, list[dict[str, Any]]]:
    """Profiles of several datasets, parked until their critical columns are confirmed."""
    return {name: profiles.profile(df) for name, df in datasets.items()}


def confirm_all(datasets: dict[str, DataFrame], parked: dict[str, list[dict[str, Any]]], chosen: dict[str, list[str]], as_of: datetime) -> tuple[dict[str, Assessment], dict[str, Any]]:
    """Assess all datasets with their chosen columns, all or none: unknown names stop it before any is scored.

    Other datasets are at hand for cross-dataset rules under their names.
    """
    if set(chosen) - set(datasets):
        raise ValueError(f"no such datasets: {', '.join(sorted(set(chosen) - set(datasets)))}")
    for name, columns in chosen.items():
        if missing := set(columns) - {c["column"] for c in parked[name]}:
            raise ValueError(f"{name} has no columns {', '.join(sorted(missing))}")
    runs = {n: assess(df, as_of, cdes=chosen.get(n), profile=[dict(c) for c in parked[n]], others={m: o for m, o in datasets.items() if m != n}) for n, df in datasets.items()}
    return runs, pool(runs)


def in_group(spark: SparkSession, group: str, work: Callable[[], Any]) -> Any:
    """Run work whose jobs ``spark.sparkContext.cancelJobGroup(group)`` stops."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


