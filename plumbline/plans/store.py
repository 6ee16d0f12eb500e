"""Artifacts of an assessment as tables: profile, results, scores and examples."""

from __future__ import annotations

import html
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..shared import commit, committed, deleted
from .assess import Assessment, report_context

TEXT_FIELDS = ("column", "inferred_type", "semantic_type")


def save(a: Assessment, path: str) -> None:
    """Write an assessment below ``path``, in place of one there: examples partitioned by validity, dimension and rule.

    All of it goes to a folder of its own, which the manifest names once it is
    complete: whoever reads meanwhile, or after a failure, finds the assessment that was there before.
    """
    spark, version = a.spark, f"v-{uuid.uuid4().hex}"
    new = f"{path}/{version}"
    spark.createDataFrame([(c["column"], k, json.dumps(c)) for k, c in enumerate(a.profile)], "column string, position int, profile string").coalesce(1).write.parquet(f"{new}/profile")
    a.results_frame().coalesce(1).write.parquet(f"{new}/results")
    meta = {"rows": a.rows, "scores": a.scores, "overall": a.overall, "bands": a.bands, "not_assessed": a.not_assessed, "errors": a.errors}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{new}/meta")
    a.examples.write.partitionBy("validity", "dimension", "rule_id").parquet(f"{new}/examples")
    before = committed(spark, path)
    commit(spark, path, {"version": version})
    if before:
        deleted(spark, f"{path}/{before['version']}")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the assessment that is complete below ``path``."""
    if (state := committed(spark, path)) is None:
        raise ValueError(f"no assessment is stored in {path}")
    return f"{path}/{state['version']}"


def load_profile(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """A stored profile, to resume an assessment from."""
    rows = spark.read.parquet(f"{current(spark, path)}/profile").orderBy("position").collect()
    out = [json.loads(r.profile) for r in rows]
    for c in out:
        for k in ("top_values", "pattern_masks"):
            c[k] = [tuple(x) for x in c[k]]
    return out


def load_meta(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.parquet(f"{current(spark, path)}/meta").first().meta)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{current(spark, path)}/results")


def load_examples(spark: SparkSession, path: str, dimension: str, rule_id: str, validity: str = "violation", limit: int = config.EXAMPLE_CAP) -> DataFrame:
    """K3: a rule's examples in row order; partition pruning reads that rule alone."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{current(spark, path)}/examples")
    return rows.where((F.col("validity") == validity) & (F.col("dimension") == dimension) & (F.col("rule_id") == rule_id)).orderBy("row").limit(limit)


def save_data(df: DataFrame, path: str) -> None:
    """K5: the dataset as CSV, without the row numbers."""
    df.drop("__row__").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def purge(spark: SparkSession, path: str) -> bool:
    """K7: delete an assessment's artifacts, in whatever store they are."""
    return deleted(spark, path)


#: What a low score of a dimension means for those who use the data.
MEANING = {
    "completeness": "Values are missing or only stand in for missing ones: counts and joins on these columns leave records out.",
    "validity": "Values do not have the form that they should have: systems that read them will refuse or misread them.",
    "uniqueness": "Records occur more than once: totals are too high, and people are written to twice.",
    "consistency": "The same thing is written in several ways: grouping by these columns splits what belongs together.",
    "accuracy": "Values are well formed but unlikely to be true: decisions that rest on them go wrong unnoticed.",
    "timeliness": "Records are old or dated ahead: they describe a state that no longer or not yet holds.",
    "integrity": "Columns contradict each other: what is looked up by one does not fit the other.",
}


def meaning_of(dimension: str, score: float | None, failed: int, why: str | None) -> str:
    """A sentence or two on what the score of a dimension says."""
    if score is None:
        return f"Not assessed: {why or 'no rule applies'}. Nothing is said about it, good or bad."
    if not failed:
        return "No rule found a fault."
    return f"{failed} findings. " + (MEANING[dimension] if score < 90 else "Few for the number of values; see the rules below.")


def render(a: Assessment, title: str = "Data quality") -> str:
    """K6: the report as one HTML page: scores, failing rules and their first rows."""
    c, e = report_context(a), lambda x: html.escape("-" if x is None else str(x))
    out = [f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1><p>Overall {e(c['overall'])}: {e(c['band'])}. {a.rows} rows.</p><table>"]
    out += [f"<tr><td>{e(d)}<td>{e(s)}<td>{e(c['not_assessed'].get(d, a.bands.get(d)))}" for d, s in c["dimensions"]]
    out.append("</table><h2>What this means</h2><dl>")
    for d, s in c["dimensions"]:
        failed = sum(r["failed"] for r in a.results if r["dimension"] == d)
        out.append(f"<dt>{e(d)}<dd>{e(meaning_of(d, s, failed, c['not_assessed'].get(d)))}")
    out.append("</dl><p>Integrity is judged within this dataset; relations to others are judged where they are given.</p>")
    if critical := [x["column"] for x in a.profile if x["is_cde"]]:
        out.append(f"<p>Judged were the critical columns {e(', '.join(critical))}.</p>")
    for r in c["rules"]:
        out.append(f"<h3>{e(r['rule_id'])} {e(r['name'])}</h3><p>{r['failed']} of {r['evaluated']} failed</p><table>")
        out += [f"<tr><td>{x['row']}<td>{e(x['column'])}<td>{e(x['value'])}<td>{e(x['reason'])}" for x in r["examples"]]
        out.append("</table>")
    return "\n".join(out)
