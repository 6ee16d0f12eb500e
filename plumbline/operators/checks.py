"""Cell checks: each is two boolean columns, evaluated and failed, and a reason.

A check is a function (x, rule, context) -> Outcome or None; None says that it
has nothing to evaluate, and the rule is pruned before any job runs.  All are
expressions inside the JVM; whatever depends on the whole column (a domain, a
median, the usual casing) comes as a literal from the context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, refdata
from ..functions import text as X
from ..functions.similarity import indel_ratio
from ..plans.rules import Rule
from ..shared import small_side, written
from .quantiles import quantiles


@dataclass
class Context:
    """What checks may look at besides a cell."""

    df: DataFrame
    profile: list[dict[str, Any]]
    as_of: datetime
    others: dict[str, DataFrame] = field(default_factory=dict)
    found: dict[tuple[str, str], Any] = field(default_factory=dict)

    def column(self, name: str) -> dict[str, Any]:
        return next(c for c in self.profile if c["column"] == name)

    def date(self, name: str) -> Column:
        """A column read as dates; read once for each row where ``prepared`` has added it."""
        made = f"__date__{name}"
        return F.col(f"`{made}`") if made in self.df.columns else X.date(F.col(f"`{name}`").cast("string"))

    def trimmed(self, name: str) -> Column:
        """A column's values, stripped, null as the empty text."""
        made = f"__trimmed__{name}"
        return F.col(f"`{made}`") if made in self.df.columns else X.trimmed(F.col(f"`{name}`").cast("string"))

    def present(self, name: str) -> Column:
        """Where a column has a value that is no placeholder."""
        made = f"__present__{name}"
        return F.col(f"`{made}`") if made in self.df.columns else X.present(F.col(f"`{name}`").cast("string"))

    def peer(self, meaning: str) -> str | None:
        """The name of the first column with a meaning."""
        return next((c["column"] for c in self.profile if c["semantic_type"] == meaning), None)

    def format(self, name: str) -> Column:
        """The name of the format a column's date is written in; read once for each row where ``prepared`` has added it."""
        made = f"__format__{name}"
        return F.col(f"`{made}`") if made in self.df.columns else X.date_format(F.col(f"`{name}`").cast("string"))

    def counts(self, kind: str, name: str) -> list[tuple[Any, int]]:
        """(key, n) of a column's casings or date formats, most frequent first."""
        if (kind, name) not in self.found:
            self.gather([Rule("", "", "", {"casing": "consistent_casing", "date_format": "single_date_format"}[kind], column=name)])
        return self.found[kind, name]

    def gather(self, rules: list[Rule]) -> None:
        """What casing, date-format and date-range rules need of whole columns, for all of them in one aggregation each."""
        kinds = {"consistent_casing": "casing", "single_date_format": "date_format"}
        wanted = dict.fromkeys((kinds[r.check], r.column) for r in rules if r.check in kinds)
        if wanted:
            keys = [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), shape(self, kind, name).alias("k")) for kind, name in wanted]
            rows = self.df.select(F.explode(F.array(*keys)).alias("s")).where("s.k is not null").groupBy("s").agg(F.count("*").alias("n"))
            self.found |= {w: [] for w in wanted}
            for r in rows.orderBy(F.desc("n"), "s.k").collect():
                self.found[r.s.kind, r.s.name].append((r.s.k, r.n))
        self.read_ranges(list(dict.fromkeys(r.column for r in rules if r.check == "within_expected_range")))

    def read_ranges(self, names: list[str]) -> None:
        """(n, 1 % quantile, 99 % quantile), in microseconds, of the present dates of each column."""
        if not (names := [n for n in names if ("date_range", n) not in self.found]):
            return
        cells = [F.struct(F.lit(n).alias("column"), F.when(self.present(n), F.unix_micros(self.date(n))).alias("x")) for n in names]
        rows = self.df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        got = rows.groupBy("column").agg(F.count("x").alias("n")).join(quantiles(rows, (0.01, 0.99)), "column", "left").collect()
        self.found |= {("date_range", n): (0, None, None) for n in names} | {("date_range", r["column"]): (r.n, r.q0, r.q1) for r in got}


def shape(context: Context, kind: str, name: str) -> Column:
    """The casing or date format of a column's present values, null for the rest."""
    if kind == "date_format":
        return F.when(context.present(name), context.format(name))
    case = X.casing(context.trimmed(name))
    return F.when(context.present(name) & (case != "none"), case)


@dataclass
class Outcome:
    """Which cells a check looks at, which of them fail, and why."""

    evaluated: Column
    failed: Column
    reason: Column | str


Check = Callable[[Column, Rule, Context], "Outcome | None"]
CELL_CHECKS: dict[str, Check] = {}


def cell_check(name: str) -> Callable[[Check], Check]:
    """Register a cell check under a name; a name may be taken once."""

    def keep(f: Check) -> Check:
        if name in CELL_CHECKS:
            raise ValueError(f"check {name} exists")
        CELL_CHECKS[name] = f
        return f

    return keep


@cell_check("not_null")
def not_null(x, rule, context):
    return Outcome(F.lit(True), context.trimmed(rule.column) == "", "empty")


@cell_check("not_placeholder")
def not_placeholder(x, rule, context):
    v = context.trimmed(rule.column)
    return Outcome(v != "", X.is_placeholder(v), "placeholder")


@cell_check("fill_rate_above")
def fill_rate_above(x, rule, context):
    threshold, fill = rule.params.get("threshold", 0.95), context.column(rule.column)["fill_rate"]
    return Outcome(F.lit(True), (context.trimmed(rule.column) == "") & F.lit(fill < threshold), f"filled to {fill:.1%}, expected {threshold:.0%}")


@cell_check("regex_match")
def regex_match(x, rule, context):
    flags = "(?i)(?U)" if rule.params.get("ignore_case", True) else "(?U)"
    return Outcome(context.present(rule.column), ~context.trimmed(rule.column).rlike(f"{flags}^(?:{rule.params['pattern']})"), "form")


@cell_check("valid_phone")
def valid_phone(x, rule, context):
    digits = F.length(F.regexp_replace(context.trimmed(rule.column), r"\D", ""))
    return Outcome(context.present(rule.column), ~digits.between(7, 15), "number of digits")


@cell_check("parseable_date")
def parseable_date(x, rule, context):
    return Outcome(context.present(rule.column), context.date(rule.column).isNull(), "no date")


@cell_check("date_in_plausible_range")
def date_in_plausible_range(x, rule, context):
    d, low = context.date(rule.column), rule.params.get("min_year", config.MIN_YEAR)
    ahead = 365 * rule.params.get("max_years_ahead", config.YEARS_AHEAD)
    return Outcome(context.present(rule.column) & d.isNotNull(), (d < F.lit(f"{low}-01-01").cast("timestamp")) | (d > day(context, ahead)), "implausible date")


@cell_check("in_enum_domain")
def in_enum_domain(x, rule, context):
    if not (domain := context.column(rule.column)["enum_domain"]):
        return None
    return Outcome(context.present(rule.column), ~F.lower(context.trimmed(rule.column)).isin(*[v.lower() for v in domain]), "outside the domain")


@cell_check("numeric_range")
def numeric_range(x, rule, context):
    n, p, out = X.number(x), rule.params, F.lit(False)
    if p.get("min") is not None:
        out = out | (n < p["min"])
    if p.get("max") is not None:
        out = out | (n > p["max"])
    if not p.get("allow_negative", True):
        out = out | (n < 0)
    return Outcome(context.present(rule.column) & n.isNotNull(), out, "outside the range")


@cell_check("length_within")
def length_within(x, rule, context):
    mean, low = context.column(rule.column)["mean_length"], rule.params.get("min", 0)
    high = rule.params.get("max")
    if high is None:
        if not mean:
            return None
        high = max(int(mean * 4), context.column(rule.column)["min_length"] + 20)
    n = F.length(context.trimmed(rule.column))
    return Outcome(context.present(rule.column), (n > high) | (n < low), f"length not within {low} to {high}")


@cell_check("type_conforms")
def type_conforms(x, rule, context):
    kind = context.column(rule.column)["inferred_type"]
    if kind in ("integer", "decimal"):
        return Outcome(context.present(rule.column), X.number(x).isNull(), f"no {kind}")
    if kind in ("date", "datetime"):
        return Outcome(context.present(rule.column), context.date(rule.column).isNull(), f"no {kind}")
    return None


@cell_check("pattern_consistent")
def pattern_consistent(x, rule, context):
    ranked, coverage = context.column(rule.column)["pattern_masks"], rule.params.get("coverage", config.PATTERN_COVERAGE)
    total = sum(n for _, n in ranked)
    if not total or ranked[0][1] / total < 0.1:
        return None
    usual, run = [], 0
    for m, n in ranked:
        if run / total >= coverage:
            break
        usual.append(m)
        run += n
    return Outcome(context.present(rule.column), ~X.mask(context.trimmed(rule.column)).isin(*usual), F.concat(F.lit("form "), X.mask(context.trimmed(rule.column)), F.lit(f" where {usual[0]} is usual")))


@cell_check("consistent_casing")
def consistent_casing(x, rule, context):
    v = context.trimmed(rule.column)
    evaluated = context.present(rule.column) & (X.casing(v) != "none")
    ranked = context.counts("casing", rule.column)
    if not ranked or ranked[0][1] / sum(n for _, n in ranked) < 0.7:
        return None
    return Outcome(evaluated, X.casing(v) != ranked[0][0], F.concat(X.casing(v), F.lit(f" case where {ranked[0][0]} is usual")))


@cell_check("no_surrounding_whitespace")
def no_surrounding_whitespace(x, rule, context):
    return Outcome(context.trimmed(rule.column) != "", x != X.strip(x), "white space around the value")


@cell_check("single_date_format")
def single_date_format(x, rule, context):
    evaluated = context.present(rule.column)
    ranked = context.counts("date_format", rule.column)
    if len(ranked) < 2 or ranked[0][0] == "other":
        return None
    return Outcome(evaluated, context.format(rule.column) != ranked[0][0], F.concat(context.format(rule.column), F.lit(f" where {ranked[0][0]} is usual")))


@cell_check("in_reference_list")
def in_reference_list(x, rule, context):
    lists = {"country": list(refdata.countries()), "currency": [c.lower() for c in refdata.CURRENCIES], "us_state": list(refdata.states())}
    if rule.params.get("list") not in lists:
        return None
    return Outcome(context.present(rule.column), ~F.lower(context.trimmed(rule.column)).isin(*lists[rule.params["list"]]), f"no known {rule.params['list']}")


def country_code(x: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(t) for pair in refdata.countries().items() for t in pair]), F.lower(x))


@cell_check("postcode_matches_country")
def postcode_matches_country(x, rule, context):
    if (country := context.peer("country")) is None:
        return None
    code, v, fits = country_code(context.trimmed(country)), context.trimmed(rule.column), F.lit(True)
    for two, pattern in refdata.POSTCODES.items():
        fits = F.when(code == two, v.rlike(pattern)).otherwise(fits)
    return Outcome(context.present(rule.column) & context.present(country), ~fits, "postcode of another country's form")


@cell_check("zip_matches_state")
def zip_matches_state(x, rule, context):
    if (state := context.peer("state")) is None:
        return None
    v, s = context.trimmed(rule.column), F.lower(context.trimmed(state))
    head, of_zip = F.left(v, F.lit(3)).try_cast("int"), F.lit(None).cast("string")
    for low, high, code in refdata.ZIP_RANGES:
        of_zip = F.when(head.between(low, high), F.lit(code)).otherwise(of_zip)
    named = F.element_at(F.create_map(*[F.lit(t) for pair in refdata.states().items() for t in pair]), s)
    return Outcome(v.rlike(r"^\d{5}") & (s != ""), F.coalesce(of_zip != named, F.lit(False)), "ZIP code of another state")


@cell_check("email_domain_plausible")
def email_domain_plausible(x, rule, context):
    threshold = rule.params.get("threshold", 85)
    v = F.lower(context.trimmed(rule.column))
    domain = F.element_at(F.split(v, "@"), -1)
    evaluated = context.present(rule.column) & v.contains("@")
    made = f"__odd__{rule.column}"
    if made not in context.df.columns:
        common = context.df.sparkSession.createDataFrame([(d,) for d in refdata.MAIL_DOMAINS], "known string")
        seen = context.df.where(evaluated).select(domain.alias("__domain__")).distinct().where(~F.col("__domain__").isin(*refdata.MAIL_DOMAINS))
        near = seen.join(F.broadcast(common), F.abs(F.length("__domain__") - F.length("known")) <= 2).withColumn("r", indel_ratio("__domain__", "known"))
        odd = written(near.where((F.col("r") >= threshold) & (F.col("r") < 100)).select("__domain__").distinct(), "domains")
        # Within two characters of a common domain each: 64 bytes are more than any has.
        hit = small_side(odd.withColumn(made, F.lit(True)), 64)
        context.df = context.df.withColumn("__domain__", F.when(evaluated, domain)).join(hit, "__domain__", "left").drop("__domain__")
    return Outcome(evaluated, F.coalesce(F.col(f"`{made}`"), F.lit(False)), "misspelt domain")


@cell_check("not_future_date")
def not_future_date(x, rule, context):
    d = context.date(rule.column)
    return Outcome(context.present(rule.column) & d.isNotNull(), d > day(context, 0), "in the future")


@cell_check("statistical_outlier")
def statistical_outlier(x, rule, context):
    c, t = context.column(rule.column), rule.params.get("threshold", config.MAD_Z)
    if not c["mad"]:
        return None
    n = X.number(x)
    return Outcome(context.present(rule.column) & n.isNotNull(), F.abs(n - c["num_median"]) * 0.6745 / c["mad"] > t, f"far from the median {c['num_median']:g}")


@cell_check("non_negative")
def non_negative(x, rule, context):
    c = context.column(rule.column)
    if not 0 < c["negatives"] <= 0.05 * c["populated"]:
        return None
    n = X.number(x)
    return Outcome(context.present(rule.column) & n.isNotNull(), n < 0, "negative, as few others")


@cell_check("not_stale")
def not_stale(x, rule, context):
    d, days = context.date(rule.column), rule.params.get("days", config.STALE_DAYS)
    return Outcome(context.present(rule.column) & d.isNotNull(), d < day(context, -days), f"older than {days} days")


@cell_check("not_future_dated")
def not_future_dated(x, rule, context):
    return not_future_date(x, rule, context)


@cell_check("within_expected_range")
def within_expected_range(x, rule, context):
    micros = F.unix_micros(context.date(rule.column))
    context.read_ranges([rule.column])
    n, low, high = context.found["date_range", rule.column]
    if n < 20:
        return None
    margin = rule.params.get("margin_days", 3650) * 86_400_000_000
    return Outcome(context.present(rule.column) & micros.isNotNull(), (micros < low - margin) | (micros > high + margin), "outside the column's range")


def day(context: Context, days: int) -> Column:
    """The moment of assessment and some days."""
    return F.lit(context.as_of) + F.make_dt_interval(F.lit(days))
