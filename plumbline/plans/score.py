"""Scores: weighted shares of failed cells, per dimension and overall, as DataFrames and as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DIMENSIONS, SEVERITY_WEIGHTS


def weight(severity: str = "severity") -> Column:
    out = F.lit(0)
    for name, w in SEVERITY_WEIGHTS.items():
        out = F.when(F.col(severity) == name, w).otherwise(out)
    return out


def dimension_scores(results: DataFrame, *by: str) -> DataFrame:
    """(by..., dimension, score): 100 less the weighted share of failures, one decimal; null where nothing was evaluated."""
    share = F.sum(weight() * F.col("failed")) / F.nullif(F.sum(weight() * F.col("evaluated")), F.lit(0))
    return results.groupBy(*by, "dimension").agg(F.round(100 * (1 - share), 1).alias("score"))


def band(score: Column) -> Column:
    """E9."""
    return F.when(score.isNull(), "not assessed").when(score >= 90, "healthy").when(score >= 70, "needs attention").otherwise("critical")


def overall(scores: DataFrame, *by: str) -> DataFrame:
    """The mean of the assessed dimensions, one decimal."""
    return scores.groupBy(*by).agg(F.round(F.avg("score"), 1).alias("overall"))


def pooled(runs: dict[str, DataFrame]) -> DataFrame:
    """X-union: rule results of several datasets with ids prefixed by their dataset."""
    out = None
    for name, results in runs.items():
        own = results.withColumn("rule_id", F.concat(F.lit(f"{name}:"), F.col("rule_id"))).withColumn("dataset", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def ranked(results: DataFrame) -> DataFrame:
    """O1: rules from the lowest pass rate up."""
    rate = F.when(F.col("evaluated") > 0, 1 - F.col("failed") / F.col("evaluated")).otherwise(F.lit(1.0))
    return results.withColumn("pass_rate", rate).orderBy("pass_rate", "rule_id")


def score_dict(results: list[dict], not_assessed: dict[str, str]) -> tuple[dict[str, float | None], float | None]:
    """The same for at most a few hundred results on the driver; rounds half to even as Python does."""
    scores: dict[str, float | None] = {}
    for d in DIMENSIONS:
        own = [r for r in results if r["dimension"] == d and d not in not_assessed]
        base = sum(SEVERITY_WEIGHTS[r["severity"]] * r["evaluated"] for r in own)
        scores[d] = round(100 * (1 - sum(SEVERITY_WEIGHTS[r["severity"]] * r["failed"] for r in own) / base), 1) if base else None
    known = [s for s in scores.values() if s is not None]
    return scores, round(sum(known) / len(known), 1) if known else None


def band_of(score: float | None) -> str:
    return "not assessed" if score is None else "healthy" if score >= 90 else "needs attention" if score >= 70 else "critical"
