"""Assessments: profile a dataset, choose critical columns, bind rules, evaluate, score.

Two families of jobs: the profile, and the evaluation, in which all cell rules
fuse into a few aggregations (BATCH rules each, so generated code stays small)
and all their examples come from one exploded pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import checks, records
from ..operators import profile as profiles
from ..operators.onepass import counted_with_examples
from ..shared import written
from . import score
from .rules import Rule, bind, default_pack

ROW = "__row__"
BATCH = 20
EXAMPLES = "rule_id string, dimension string, validity string, row long, column string, value string, reason string"


@dataclass
class Assessment:
    """What an assessment yields; examples is a lazy DataFrame, planned when first asked for, all else is small."""

    spark: SparkSession
    rows: int
    profile: list[dict[str, Any]]
    rules: list[Rule]
    results: list[dict[str, Any]]
    errors: dict[str, str]
    not_assessed: dict[str, str]
    found_examples: Callable[[], list[DataFrame]]
    scores: dict[str, float | None] = field(default_factory=dict)
    overall: float | None = None

    @cached_property
    def examples(self) -> DataFrame:
        none = self.spark.createDataFrame([], EXAMPLES)
        return reduce(DataFrame.unionByName, self.found_examples(), none)

    @property
    def bands(self) -> dict[str, str]:
        return {d: score.band_of(s) for d, s in self.scores.items()}

    def results_frame(self) -> DataFrame:
        schema = "rule_id string, template_id string, name string, dimension string, severity string, column string, evaluated long, failed long"
        return self.spark.createDataFrame([tuple(r[k.split()[0]] for k in schema.split(", ")) for r in self.results], schema)

    def dimension(self, name: str) -> list[dict[str, Any]]:
        """A dimension's rules, worst first."""
        own = [r | {"pass_rate": 1 - r["failed"] / r["evaluated"] if r["evaluated"] else 1.0} for r in self.results if r["dimension"] == name]
        return sorted(own, key=lambda r: (r["pass_rate"], r["rule_id"]))

    def rule_examples(self, rule_id: str, validity: str = "violation", limit: int = config.EXAMPLE_CAP) -> tuple[int, DataFrame]:
        """How many cells failed (or passed), and the first of them in row order."""
        own = next(r for r in self.results if r["rule_id"] == rule_id)
        total = own["failed"] if validity == "violation" else own["evaluated"] - own["failed"]
        return total, self.examples.where((F.col("rule_id") == rule_id) & (F.col("validity") == validity)).orderBy("row").limit(limit)


def numbered(df: DataFrame) -> DataFrame:
    """A dataset read from Parquet with ``__row__``: the place in its file where it is one file, else a dense rank over file and place."""
    if ROW in df.columns:
        return df
    raise ValueError(f"give the dataset a column {ROW} (long, unique, in record order); sources.rowcsv and sources.parquet do")


def prepared(df: DataFrame, profile: list[dict[str, Any]]) -> DataFrame:
    """With what many rules ask of each critical column, worked out once: stripped text, presence, date and format of the date."""
    made = {}
    for c in profile:
        if c["is_cde"]:
            name, x = c["column"], F.col(f"`{c['column']}`").cast("string")
            made |= {f"__trimmed__{name}": X.trimmed(x), f"__present__{name}": X.present(x)}
            if c["semantic_type"] in ("date", "datetime") or c["inferred_type"] in ("date", "datetime"):
                made |= {f"__date__{name}": X.date(x), f"__format__{name}": X.date_format(x)}
    return df.withColumns(made) if made else df


def outcomes(rules: list[Rule], context: checks.Context, errors: dict[str, str]) -> list[tuple[Rule, checks.Outcome]]:
    """Cell rules with what they evaluate; rules with nothing to evaluate are pruned, failing ones recorded."""
    out = []
    try:
        context.gather(rules)
    except Exception:
        context.found.clear()  # each rule asks alone then, so that a faulty one is recorded as its own
    for rule in rules:
        if rule.check not in checks.CELL_CHECKS:
            continue
        try:
            got = checks.CELL_CHECKS[rule.check](F.col(f"`{rule.column}`").cast("string"), rule, context)
            if got is not None:
                context.df.select(got.evaluated & got.failed)  # analysed now, so one faulty rule does not stop the others
                out.append((rule, got))
        except Exception as e:
            errors[rule.id] = str(e)
    return out


def cell_counts(df: DataFrame, bound: list[tuple[Rule, checks.Outcome]]) -> list[tuple[int, int]]:
    """(evaluated, failed) for each rule, in fused aggregations."""
    out: list[tuple[int, int]] = []
    for at in range(0, len(bound), BATCH):
        part = bound[at : at + BATCH]
        row = df.agg(*[f for k, (_, o) in enumerate(part) for f in (F.count_if(o.evaluated).alias(f"e{k}"), F.count_if(o.evaluated & o.failed).alias(f"f{k}"))]).first()
        out += [(row[f"e{k}"], row[f"f{k}"]) for k in range(len(part))]
    return out


def shown_and_reason(rule: Rule, o: checks.Outcome) -> tuple[Column, Column, Column, Column]:
    """What ``onepass`` asks of a cell rule."""
    reason = F.lit(rule.message or o.reason) if isinstance(o.reason, str) else (F.lit(rule.message) if rule.message else o.reason)
    return o.evaluated, o.failed, X.shown(F.col(f"`{rule.column}`").cast("string")), reason


def counts_and_examples(df: DataFrame, bound: list[tuple[Rule, checks.Outcome]], cap: int = config.EXAMPLE_CAP) -> tuple[list[tuple[int, int]], DataFrame]:
    """(evaluated, failed) of each rule, and its first ``cap`` violations and valid values in row order, from one pass (BATCH rules each)."""
    counts, examples = [], []
    for part in itertools.batched(bound, BATCH):
        found = written(counted_with_examples(df, [shown_and_reason(r, o) for r, o in part], cap), "onepass")
        n = {(r["rule"], r["failed"]): r["n"] for r in found.where("n is not null").collect()}
        counts += [(n.get((k, False), 0) + n.get((k, True), 0), n.get((k, True), 0)) for k in range(len(part))]
        names = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.dimension).alias("dimension"), F.lit(r.column).alias("column")) for r, _ in part])
        own = found.where("n is null").withColumn("_r", F.element_at(names, F.col("rule") + 1))
        examples.append(own.select("_r.rule_id", "_r.dimension", F.when(F.col("failed"), "violation").otherwise("valid").alias("validity"), "row", "_r.column", "value", "reason"))
    return counts, reduce(DataFrame.unionByName, examples, df.sparkSession.createDataFrame([], EXAMPLES))


def cell_examples(df: DataFrame, bound: list[tuple[Rule, checks.Outcome]], cap: int = config.EXAMPLE_CAP) -> DataFrame | None:
    """The first ``cap`` violations and valid values of each rule in row order."""
    return counts_and_examples(df, bound, cap)[1] if bound else None


def record_examples(rule: Rule, rows: DataFrame, cap: int) -> DataFrame:
    """The first violations and valid rows of a record rule."""
    failed = F.col("failed")
    own = rows.select(F.lit(rule.id).alias("rule_id"), F.lit(rule.dimension).alias("dimension"), F.when(failed, "violation").otherwise("valid").alias("validity"), "row", "column", "value", F.when(failed, F.coalesce("reason", F.lit(rule.message))).alias("reason"))
    return first_of_each(own, cap)


def first_of_each(rows: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("rule_id", "validity").orderBy("row")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap).drop("_k")


def assess(df: DataFrame, as_of: datetime, rules: list[Rule] | None = None, cdes: list[str] | None = None, profile: list[dict] | None = None, others: dict[str, DataFrame] | None = None, cap: int = config.EXAMPLE_CAP, with_examples: bool = False) -> Assessment:
    """Assess a dataset with ``__row__``; ``profile`` resumes from one made before (P19), ``cdes`` overrides the critical columns.

    ``with_examples`` takes counters and examples of cell rules from the same pass; else examples are looked for when asked for.
    """
    df = numbered(df)
    if profile is None:
        profile = profiles.profile(df, cdes)
    elif unknown := profiles.mark_cdes(profile, max((c["total"] for c in profile), default=0), cdes):
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    rows = max((c["total"] for c in profile), default=0)
    gates = {"timeliness": records.timeliness_gate(profile), "integrity": records.integrity_gate(profile, rows)}
    not_assessed = {d: why for d, why in gates.items() if why}
    bound = [r for r in bind(rules or default_pack(), profile) if r.dimension not in not_assessed]
    errors: dict[str, str] = {}
    context = checks.Context(written(prepared(df, profile), "prepared"), profile, as_of, others or {})
    cells = outcomes(bound, context, errors)
    df = context.df
    results, record_rows = [], []
    counts, at_once = counts_and_examples(df, cells, cap) if with_examples else (cell_counts(df, cells), None)
    for (rule, _), (evaluated, failed) in zip(cells, counts, strict=True):
        results.append((rule, evaluated, failed))
    for rule in bound:
        if rule.check in records.RECORD_CHECKS:
            try:
                found = records.RECORD_CHECKS[rule.check](rule, context)
            except Exception as e:
                errors[rule.id] = str(e)
                continue
            if found is not None:
                results.append((rule, found.evaluated, found.failed))
                record_rows.append((rule, found.rows))
    order = {r.id: k for k, r in enumerate(bound)}
    kept = [
        {"rule_id": r.id, "template_id": r.template_id, "name": r.name, "dimension": r.dimension, "severity": r.severity, "column": r.column, "evaluated": e, "failed": f}
        for r, e, f in sorted(results, key=lambda x: order[x[0].id])
        if e
    ]
    for d in config.DIMENSIONS:
        if d not in not_assessed and not any(r["dimension"] == d for r in kept):
            not_assessed[d] = "no rule applies"

    def examples() -> list[DataFrame]:
        made = [record_examples(r, rows, cap) for r, rows in record_rows]
        own = at_once if at_once is not None else cell_examples(df, cells, cap)
        return [own, *made] if own is not None else made

    out = Assessment(df.sparkSession, rows, profile, bound, kept, errors, not_assessed, examples)
    out.scores, out.overall = score.score_dict(kept, not_assessed)
    return out


def pool(runs: dict[str, Assessment]) -> dict[str, Any]:
    """One score over several datasets: their results together."""
    if not 1 <= len(runs) <= config.ASSESSMENT_MAX_OBJECTS:
        raise ValueError(f"give 1 to {config.ASSESSMENT_MAX_OBJECTS} datasets")
    results = [r | {"rule_id": f"{name}:{r['rule_id']}"} for name, a in runs.items() for r in a.results]
    missing = {d: "; ".join(dict.fromkeys(a.not_assessed[d] for a in runs.values())) for d in config.DIMENSIONS if all(d in a.not_assessed for a in runs.values())}
    scores, overall = score.score_dict(results, missing)
    return {"results": results, "scores": scores, "overall": overall, "not_assessed": missing, "objects": {n: a.overall for n, a in runs.items()}}


def report_context(a: Assessment) -> dict[str, Any]:
    """What a report shows: dimensions worst first, failing rules with their first rows."""
    failing = [r for d in config.DIMENSIONS for r in a.dimension(d)[: config.REPORT_RULES] if r["failed"]]
    ids = [r["rule_id"] for r in failing]
    rows: dict[str, list] = {i: [] for i in ids}
    if ids:
        w = Window.partitionBy("rule_id").orderBy("row")
        chosen = a.examples.where(F.col("rule_id").isin(*ids) & (F.col("validity") == "violation")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= config.REPORT_ROWS)
        for r in chosen.orderBy("rule_id", "row").drop("_k").collect():
            rows[r.rule_id].append(r.asDict())
    dims = sorted(a.scores.items(), key=lambda x: (x[1] is None, x[1] or 0))
    return {"overall": a.overall, "band": score.band_of(a.overall), "dimensions": dims, "rules": [r | {"examples": rows[r["rule_id"]]} for r in failing], "not_assessed": a.not_assessed}
