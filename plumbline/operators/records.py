"""Checks over whole datasets: duplicates, near duplicates and inferred relationships.

Each returns a DataFrame of findings (row, column, value, reason, failed) for
every evaluated row, or its own counts; all are windows, joins or one-pass
conditional counts on data keyed by hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..functions.phonetic import phonetic_codes
from ..plans.rules import Rule
from ..shared import small_side, written
from . import fuzzy
from .checks import Context

ROW = "__row__"
SEPARATOR = "\x1f"
FINDINGS = "row long, column string, value string, reason string, failed boolean"


@dataclass
class Found:
    """Counts of a record check and the rows behind them."""

    evaluated: int
    failed: int
    rows: DataFrame


RECORD_CHECKS: dict[str, Callable[[Rule, Context], Found | None]] = {}


def record_check(name: str):
    """Register a record check under a name; a name may be taken once."""

    def keep(f):
        if name in RECORD_CHECKS:
            raise ValueError(f"check {name} exists")
        RECORD_CHECKS[name] = f
        return f

    return keep


def text_of(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def cdes(context: Context) -> list[dict]:
    return [c for c in context.profile if c["is_cde"]]


def counted(rows: DataFrame) -> Found | None:
    n = rows.agg(F.count("*").alias("n"), F.count_if("failed").alias("f")).first()
    return Found(n.n, n.f, rows) if n.n else None


def later_occurrences(df: DataFrame, key: Column, shown: Column, column: str | None) -> DataFrame:
    """Every row with its key's first row; occurrences after the first fail.

    The first row of each key is a pre-aggregated minimum joined back, so one
    key may hold any share of the rows.
    """
    keyed = df.select(F.col(ROW).alias("row"), F.xxhash64(key, F.lit(1)).alias("a"), F.xxhash64(key, F.lit(2)).alias("b"), shown.alias("value"))
    firsts = keyed.groupBy("a", "b").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = keyed.join(firsts, ["a", "b"], "left")
    failed = F.coalesce(F.col("row") > F.col("first"), F.lit(False))
    reason = F.when(failed, F.concat(F.lit("same as row "), F.col("first").cast("string")))
    return out.select("row", F.lit(column).cast("string").alias("column"), "value", reason.alias("reason"), failed.alias("failed"))


@record_check("exact_record_duplicate")
def exact_record_duplicate(rule: Rule, context: Context) -> Found | None:
    names = [c["column"] for c in cdes(context)]
    if not names:
        return None
    key = F.concat_ws(SEPARATOR, *[F.lower(context.trimmed(n)) for n in names])
    blank = key == SEPARATOR * (len(names) - 1)
    key = F.when(blank, F.concat(key, F.col(ROW).cast("string"))).otherwise(key)
    shown = F.when(blank, "(blank)").otherwise(F.left(F.replace(key, F.lit(SEPARATOR), F.lit(" | ")), F.lit(config.VALUE_CHARS)))
    return counted(later_occurrences(context.df, key, shown, None))


def key_column(context: Context, distinctness: float) -> str | None:
    """The first column that looks like a key, an identifier before others."""
    fit = [c for c in cdes(context) if c["distinct_ratio"] >= distinctness and c["fill_rate"] > 0.5]
    return next((c["column"] for c in fit if c["semantic_type"] == "identifier"), fit[0]["column"] if fit else None)


@record_check("candidate_key_duplicate")
def candidate_key_duplicate(rule: Rule, context: Context) -> Found | None:
    if (name := key_column(context, rule.params.get("distinctness", 0.95))) is None:
        return None
    x = text_of(name)
    rows = context.df.where(context.trimmed(name) != "")
    return counted(later_occurrences(rows, F.lower(context.trimmed(name)), X.shown(x), name))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of the undirected edges (a, b): smallest reachable node, by alternating star steps, each written to the shared folder."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# Fixed value: identity fields that the rule compares.
IDENTITY_FIELDS = 6
IDENTITY = ("person_name", "org_name", "email", "phone", "address")


def behind(head: Column) -> Callable[[Column], Column]:
    return lambda code: F.concat(head, code)


def fuzzy_keys(context: Context, limit: int | None = IDENTITY_FIELDS, phonetic: bool = False) -> DataFrame | None:
    """(row, text, keys) with the blocking keys of a record: mail name, last digits, head and skeleton of names; of the first ``limit`` identity fields.

    ``phonetic`` takes the head with each of the name's two phonetic codes in place of the skeleton, so that names meet on either code.
    """
    fields = [c for c in cdes(context) if c["semantic_type"] in IDENTITY][:limit]
    if not fields:
        return None
    keys, codes = [], []
    for c in fields:
        x, kind = text_of(c["column"]), c["semantic_type"]
        v = F.lower(context.trimmed(c["column"]))
        if kind == "email":
            keys.append(F.when(v.contains("@") & (F.split(v, "@")[0] != ""), F.concat(F.lit("e:"), F.split(v, "@")[0])))
        elif kind == "phone":
            digits = F.regexp_replace(v, r"\D", "")
            keys.append(F.when(F.length(digits) >= 7, F.concat(F.lit("p:"), F.right(digits, F.lit(7)))))
        else:
            t = X.normalised(x)
            if phonetic:
                head = F.concat(F.lit("n:"), F.left(t, F.lit(3)), F.lit(":"))
                codes.append(F.when(F.length(t) >= 3, F.transform(phonetic_codes(t), behind(head))))
                continue
            keys.append(F.when(F.length(t) >= 3, F.concat(F.lit("n:"), F.left(t, F.lit(3)), F.left(F.regexp_replace(t, "[aeiou]", ""), F.lit(4)))))
    whole = F.concat_ws(" ", *[F.when(X.normalised(text_of(c["column"])) != "", X.normalised(text_of(c["column"]))) for c in fields])
    rows = context.df.select(F.col(ROW).alias("row"), whole.alias("text"), F.concat(F.array_compact(F.array(*keys).cast("array<string>")), *[F.coalesce(k, F.array().cast("array<string>")) for k in codes]).alias("keys")).where("text <> ''")
    return rows


@record_check("fuzzy_duplicate")
def fuzzy_duplicate(rule: Rule, context: Context) -> Found | None:
    if (rows := fuzzy_keys(context, rule.params.get("max_fields", IDENTITY_FIELDS), rule.params.get("phonetic", False))) is None:
        return None
    rows = written(rows, "fuzzy")
    member = components(fuzzy.links(rows, rule.params.get("threshold", config.FUZZY_THRESHOLD), rule.params.get("max_block_size")))
    out = rows.join(member, rows.row == member.node, "left")
    failed = F.coalesce(F.col("row") != F.col("component"), F.lit(False))
    reason = F.when(failed, F.concat(F.lit("similar to row "), F.col("component").cast("string")))
    return counted(out.select("row", F.lit(None).cast("string").alias("column"), F.left("text", F.lit(config.VALUE_CHARS)).alias("value"), reason.alias("reason"), failed.alias("failed")))


def determinants(profile: list[dict]) -> list[dict]:
    """Populated critical columns with few enough values to determine others."""
    return [c for c in profile if c["is_cde"] and c["populated"] and 2 <= c["distinct"] <= config.FD_MAX_KEYS and c["distinct_ratio"] <= config.FD_MAX_RATIO]


def fd_pairs(profile: list[dict], limit: int | None = None) -> list[tuple[str, str]]:
    """Pairs (determinant, dependent) worth looking at, in column order: all, or the first ``limit`` (FD_MAX_PAIRS as the rule once had it)."""
    dependents = [c for c in profile if c["is_cde"] and c["populated"]]
    return [(a["column"], b["column"]) for a in determinants(profile) for b in dependents if a is not b and b["distinct"] <= a["distinct"]][:limit]


def fd_conflicts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(det, dep, row, key, value, expected, conflict): for each pair the rows where both are present, against the first row of their key."""
    names = list(dict.fromkeys(n for p in pairs for n in p))
    once = df.select(F.col(ROW).alias("row"), *[f for k, n in enumerate(names) for f in (X.trimmed(text_of(n)).alias(f"v{k}"), X.present(text_of(n)).alias(f"p{k}"))])
    at = {n: k for k, n in enumerate(names)}
    made = F.array(*[F.struct(F.lit(a).alias("det"), F.lit(b).alias("dep"), F.lower(F.col(f"v{at[a]}")).alias("key"), F.col(f"v{at[b]}").alias("value"), (F.col(f"p{at[a]}") & F.col(f"p{at[b]}")).alias("ok")) for a, b in pairs])
    rows = once.select("row", F.explode(made).alias("p")).where("p.ok").select("p.det", "p.dep", "row", "p.key", "p.value")
    firsts = written(rows.groupBy("det", "dep", "key").agg(F.min_by("value", "row").alias("expected")), "firsts")
    return rows.join(small_side(firsts, 120), ["det", "dep", "key"]).withColumn("conflict", F.lower("value") != F.lower("expected"))


def fd_choose(stats: list[dict]) -> list[dict]:
    """One determinant for each dependent: the most consistent, then the one with most keys, then the first."""
    best: dict[str, dict] = {}
    for s in stats:
        if s["groups"] >= config.FD_MIN_GROUPS and (rate := 1 - s["conflicts"] / s["evaluated"]) >= config.FD_CONSISTENCY:
            if s["dep"] not in best or (rate, s["groups"]) > best[s["dep"]]["rank"]:
                best[s["dep"]] = s | {"rank": (rate, s["groups"])}
    return [best[d] for d in sorted(best)]


@record_check("cardinality_holds")
def cardinality_holds(rule: Rule, context: Context) -> Found | None:
    if not (pairs := fd_pairs(context.profile, rule.params.get("max_pairs"))):
        return None
    rows = fd_conflicts(context.df, pairs)
    stats = {(r.det, r.dep): r.asDict() for r in rows.groupBy("det", "dep").agg(F.count("*").alias("evaluated"), F.count_if("conflict").alias("conflicts"), F.count_distinct("key").alias("groups")).collect()}
    chosen = fd_choose([stats[p] for p in pairs if p in stats])
    if not chosen:
        return None
    of = F.array(*[F.struct(F.lit(c["det"]).alias("det"), F.lit(c["dep"]).alias("dep")) for c in chosen])
    out = rows.where(F.array_contains(of, F.struct("det", "dep")))
    reason = F.when(F.col("conflict"), F.concat(F.col("det"), F.lit(" "), F.col("key"), F.lit(" has "), F.col("dep"), F.lit(" "), F.col("expected"), F.lit(", here "), F.col("value")))
    shown = out.select("row", F.col("dep").alias("column"), X.shown(F.col("value")).alias("value"), reason.alias("reason"), F.col("conflict").alias("failed"))
    return Found(sum(c["evaluated"] for c in chosen), sum(c["conflicts"] for c in chosen), shown)


@record_check("dependent_field_populated")
def dependent_field_populated(rule: Rule, context: Context) -> Found | None:
    support = rule.params.get("support", config.DEPENDENT_SUPPORT)
    fit = [c for c in context.profile if c["is_cde"] and c["populated"]]
    pairs = [(a["column"], b["column"]) for a in fit for b in fit if a is not b and b["fill_rate"] < 1][: rule.params.get("max_pairs")]
    if not pairs:
        return None
    names = list(dict.fromkeys(n for p in pairs for n in p))
    once = context.df.select(*[context.present(n).alias(f"p{k}") for k, n in enumerate(names)])
    here = [(F.col(f"p{names.index(a)}"), F.col(f"p{names.index(b)}")) for a, b in pairs]
    counts = once.agg(*[f for k, (a, b) in enumerate(here) for f in (F.count_if(a).alias(f"s{k}"), F.count_if(a & b).alias(f"b{k}"))]).first()
    best: dict[str, tuple] = {}
    for k, (a, b) in enumerate(pairs):
        seen, both = counts[f"s{k}"], counts[f"b{k}"]
        if seen >= config.INTEGRITY_MIN_ROWS and both / seen >= support and (b not in best or both / seen > best[b][0]):
            best[b] = (both / seen, seen, both, a)
    if not best:
        return None
    made = F.array(*[F.struct(F.lit(b).alias("column"), X.shown(text_of(b)).alias("value"), F.lit(f"{a} is filled").alias("reason"), context.present(a).alias("ok"), (~context.present(b)).alias("failed")) for b, (_, _, _, a) in sorted(best.items())])
    rows = context.df.select(F.col(ROW).alias("row"), F.explode(made).alias("p")).where("p.ok").select("row", "p.column", "p.value", "p.reason", "p.failed")
    return Found(sum(v[1] for v in best.values()), sum(v[1] - v[2] for v in best.values()), rows)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose present key is not found in the other dataset."""
    keys = parent.select(F.lower(X.trimmed(text_of(parent_key))).alias("_key")).distinct()
    return child.where(X.present(text_of(child_key))).withColumn("_key", F.lower(X.trimmed(text_of(child_key)))).join(keys, "_key", "left_anti").drop("_key")


def _other(rule: Rule, context: Context, key_param: str) -> tuple[DataFrame, str] | None:
    other = context.others.get(rule.params.get("dataset") or rule.params.get("parent_dataset") or "")
    return (other, rule.params[key_param]) if other is not None else None


@record_check("foreign_key_resolves")
def foreign_key_resolves(rule: Rule, context: Context) -> Found | None:
    """Keys of this dataset exist in another; lookup_code_resolves is the same over a code table."""
    if (found := _other(rule, context, "parent_key")) is None:
        return None
    name = rule.params["key"]
    keys = found[0].select(F.lower(X.trimmed(text_of(found[1]))).alias("_key"), F.lit(True).alias("_hit")).distinct()
    rows = context.df.where(X.present(text_of(name))).select(F.col(ROW).alias("row"), X.shown(text_of(name)).alias("value"), F.lower(X.trimmed(text_of(name))).alias("_key")).join(keys, "_key", "left")
    return counted(rows.select("row", F.lit(name).alias("column"), "value", F.lit("no such parent").alias("reason"), F.col("_hit").isNull().alias("failed")))


@record_check("lookup_code_resolves")
def lookup_code_resolves(rule: Rule, context: Context) -> Found | None:
    return foreign_key_resolves(rule, context)


@record_check("mandatory_child_exists")
def mandatory_child_exists(rule: Rule, context: Context) -> Found | None:
    """Every key of this dataset occurs in a child dataset."""
    return foreign_key_resolves(rule, context)


def integrity_gate(profile: list[dict], rows: int) -> str | None:
    """I4: why integrity cannot be assessed, or None."""
    if len(profile) < 2:
        return "a single column has no relationships"
    if sum(c["is_cde"] and c["populated"] > 0 for c in profile) < 2:
        return "fewer than two populated critical columns"
    if rows < config.INTEGRITY_MIN_ROWS:
        return f"fewer than {config.INTEGRITY_MIN_ROWS} rows"
    return None


def timeliness_gate(profile: list[dict]) -> str | None:
    """Why timeliness cannot be assessed, or None."""
    dates = [c for c in profile if c["semantic_type"] in ("date", "datetime") or c["inferred_type"] in ("date", "datetime") or c["date_parse_rate"] >= 0.8]
    if not dates:
        return "no date column"
    filled = [c for c in dates if c["fill_rate"] > 0.05]
    if not filled:
        return "date columns are empty"
    return None if any(c["is_cde"] for c in filled) else "no date column is critical"


