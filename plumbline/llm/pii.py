"""Personal data: candidate spans from high-recall patterns, judged by gradient-boosted trees.

All of it is DataFrame functions.  Base spans follow fixed rules and always stay.
Further generators propose spans that may overlap: grouped and bare card numbers
inside longer digit runs, telephone numbers without a plus, masked addresses,
secrets, identity numbers, and whatever a base pattern matched but its rule
refused.  Depth-two trees look at the format of a candidate (kind, digits,
letters, groups, checksum, variety, first character, length) and at the words
around it.  All examples are rewritten and counted by feature vector in Spark; boosting
runs on those counts, whose number the few bins of a vector bound, not that of the texts.  Trees and
thresholds then judge every candidate of every text inside the query.

There are no labelled spans, so labels come by construction: spans that satisfy
a strict rule, and rewritten forms of them, count as personal data; the same spans with a
broken checksum, cut in half, without digits, or behind words such as "version" do not.  On a quarter
of the examples, kept apart, each kind gets the lowest threshold at which the share of
true ones above it is at least ``PRECISION``; a kind without one adds nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "id", "secret")
EMAIL, IP, CARD, PHONE, ID, SECRET = range(6)

#: The base rules' patterns, written so that no start is tried twice and nothing recurses: what a run of letters or digits does not
#: match from its beginning it does not match from later on, but for a run that the last match has left over (\G).
BASE = {
    EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried: cheap to look for.
DIGITS = "text rlike '[0-9]{3}'"
#: Further generators: kind, pattern, and what a text must hold.
GENERATORS = (
    (CARD, r"(?<![0-9])[0-9]{12,19}(?![0-9])", DIGITS),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])", DIGITS),
    (PHONE, r"(?<![0-9+(])(?:\([0-9]{2,4}\)|0[0-9]{1,3}|[0-9]{3})[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", DIGITS),
    (EMAIL, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:[\[({]at[\])}]|＠)\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]++)++", "contains(text, 'at]') or contains(text, 'at)') or contains(text, 'at}') or contains(text, '＠')"),
    (IP, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "text rlike ':[0-9A-Fa-f]{1,4}:'"),
    (ID, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", DIGITS + " and contains(text, '-')"),
    (ID, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", DIGITS),
    (SECRET, r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)\b[\"']?\x20?[=:]\x20?[\"']?[^\s\"'<>]{8,200}", "contains(text, '=') or contains(text, ':')"),
    (SECRET, r"(?<![0-9A-Za-z])(?:[A-Z]{4}[0-9A-Z]{16}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])", "text rlike '[0-9]'"),
)
#: Words before a candidate that speak for its kind, and those that speak against any.
FOR = ("e-?mail|mail|contact", r"\bip\b|host|server|address", "card|visa|credit|pay", "call|phone|tel|fax|mobile|whatsapp", "ssn|social|iban|account|passport", "password|token|secret|key|login|auth")
AGAINST = r"version|\bv\.|isbn|issn|\bdoi\b|page|chapter|section|invoice|order|serial|\bno\.|release|total|figure"
BEFORE, AFTER = 24, 8
#: Places in a list of matches that one pass adds up before it starts a list anew.
CHUNK = 256

#: Rounds, shrinkage, smoothing of a leaf, and the precision that a threshold must keep.
ROUNDS, SHRINK, RIDGE, PRECISION = 24, 0.4, 1.0, 0.97
FEATURES = ("kind", "digits", "letters", "groups", "check", "variety", "lead", "cue", "tail", "size")
NO_SPANS = "array<struct<k:int,s:int,e:int,t:string,b:string,a:string>>"


def with_spans(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with an array of spans for each pattern: _base0 to _base3, then _more0 and on.

    A span has its kind k, start s and end e in code points, text t, and what stands before (b) and after it (a).
    Places are sums of the lengths of matches and of what lies between them: within chunks first, then over chunks, so that
    no list is copied more than CHUNK times.
    """
    holds = {EMAIL: "contains(text, '@')", PHONE: "contains(text, '+')"}
    wanted = [(f"_base{k}", k, p, holds.get(k, "text rlike '[0-9]'")) for k, p in BASE.items()] + [(f"_more{i}", *g) for i, g in enumerate(GENERATORS)]

    def each(column: str, sql: str) -> dict[str, Column]:
        return {f"{name}_{column}": F.expr(sql.replace("@", name).replace("KIND", str(k))) for name, k, _, _ in wanted}

    found = rows.withColumns({f"{name}_f": F.when(F.expr(held), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for name, _, p, held in wanted})
    cut = found.withColumns({f"{name}_g": F.when(F.size(f"{name}_f") > 0, F.split("text", p, -1)) for name, _, p, _ in wanted})
    sums = f"""case when size(@_f) > 0 then transform(sequence(0, (size(@_f) - 1) div {CHUNK}), c -> aggregate(sequence(c * {CHUNK}, least((c + 1) * {CHUNK}, size(@_f)) - 1),
        array(0), (out, i) -> concat(out, array(element_at(out, -1) + length(@_g[i]) + length(@_f[i]))))) end"""
    summed = cut.withColumns(each("p", sums))
    offsets = summed.withColumns(each("o", "aggregate(@_p, array(0), (out, p) -> concat(out, array(element_at(out, -1) + element_at(p, -1))))"))
    end = f"(@_o[i div {CHUNK}] + @_p[i div {CHUNK}][i % {CHUNK} + 1])"
    spans = f"""coalesce(case when size(@_f) > 0 then transform(@_f, (t, i) -> struct(KIND as k, {end} - length(t) as s, {end} as e, t as t, right(@_g[i], {BEFORE}) as b, left(@_g[i + 1], {AFTER}) as a)) end,
        cast(array() as {NO_SPANS}))"""
    return offsets.select(*rows.columns, *[c.alias(name[:-2]) for name, c in each("s", spans).items()])


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def small_parts(t: Column) -> Column:
    return F.forall(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]?[0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def base_rule(kind: int) -> Callable[[Column], Column]:
    """What a base match must satisfy."""
    if kind == IP:
        return lambda x: small_parts(x["t"])
    if kind == CARD:
        n = lambda x: F.length(digits_of(x["t"]))
        return lambda x: F.when(n(x).between(16, 19), luhn(digits_of(x["t"]))).otherwise(False)
    if kind == PHONE:
        return lambda x: F.length(digits_of(x["t"])).between(8, 15)
    return lambda x: F.lit(True)


def iban(t: Column) -> Column:
    """Whether the digits of an IBAN leave 1 on division by 97."""
    s = F.regexp_replace(t, " ", "")
    turned = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda m, c: (m * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def strict(x: Column) -> Column:
    """Whether a candidate satisfies the strict rule of its kind: the checksum feature, and what makes examples."""
    t = x["t"]
    digits = digits_of(t)
    n = F.length(digits)
    mixed = t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    return (
        F.when(x["k"] == IP, F.when(F.contains(t, F.lit(":")), True).otherwise(small_parts(t)))
        .when(x["k"] == CARD, F.when(n.between(13, 19), luhn(digits)).otherwise(False))
        .when(x["k"] == PHONE, n.between(8, 15))
        .when(x["k"] == ID, F.when(t.rlike("^[0-9]"), ~t.rlike("^(000|666|9)|-00-|-0000$")).otherwise(iban(t)))
        .when(x["k"] == SECRET, mixed)
        .otherwise(True)
    )


def features(x: Column) -> Column:
    """The bins of a candidate, an integer for each of FEATURES."""
    t, before = x["t"], F.lower(x["b"])
    few = lambda c, most: F.least(c, F.lit(most))
    cue = F.when(before.rlike(AGAINST), 0)
    for k, words in enumerate(FOR):
        cue = cue.when((x["k"] == k) & before.rlike(words), 2)
    return F.array(
        x["k"],
        few(F.length(digits_of(t)), 20),
        few(F.length(F.regexp_replace(t, "[^A-Za-z]", "")), 24),
        few(F.size(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))), 8),
        strict(x).cast("int"),
        few(F.size(F.array_distinct(F.split(F.left(t, F.lit(64)), ""))), 16),
        F.when(t.startswith("+"), 0).when(t.startswith("("), 1).when(t.rlike("^[0-9]"), 2).otherwise(3),
        cue.otherwise(1),
        F.when(x["a"].rlike(r"^[.,]?[0-9A-Za-z]|^ ?[%$€]"), 1).otherwise(0),
        few(F.floor(F.length(t) / 2).cast("int"), 20),
    )


def candidates() -> Column:
    """All spans that the patterns propose, of the columns of ``with_spans``; of refused digit runs those of 12 digits and more."""

    def refused(kind: int) -> Callable[[Column], Column]:
        return lambda x: ~base_rule(kind)(x) & (F.lit(kind != CARD) | (F.length(digits_of(x["t"])) >= 12))

    return F.concat(*[F.filter(f"_base{k}", refused(k)) for k in (IP, CARD, PHONE)], *[F.col(f"_more{i}") for i in range(len(GENERATORS))])


def variants(x: Column) -> Column:
    """Examples from a span that satisfies its strict rule: itself and rewritten forms (label 1), spoilt forms (label 0)."""
    t, k = x["t"], x["k"]

    def form(text: Column, before: Column, label: int, when: Column) -> Column:
        return F.when(when, F.struct(k.alias("k"), text.alias("t"), before.alias("b"), x["a"].alias("a"), F.lit(label).alias("label")))

    always, b = F.lit(True), x["b"]
    last = F.concat(F.left(t, F.length(t) - 1), F.translate(F.right(t, F.lit(1)), "0123456789", "1234567890"))
    plain = F.translate(t, "0123456789", "aeiounrstl")
    made = [
        form(t, b, 1, always),
        form(t, F.lit("by mail or phone or card: "), 1, k <= PHONE),
        form(F.regexp_replace(t, r"([0-9]{4})[\x20-]?(?=[0-9])", "$1-"), b, 1, k == CARD),
        form(F.regexp_replace(t, "@", " [at] "), b, 1, k == EMAIL),
        form(F.regexp_replace(t, r"^\+[0-9]{1,2}[\x20-]?", ""), F.lit("please call "), 1, k == PHONE),
        form(last, b, 0, k == CARD),
        form(F.concat(F.lit("password="), F.right(F.regexp_replace(t, "[^0-9A-Za-z]", ""), F.lit(18))), b, 1, (k == SECRET) & (F.length(t) >= 18)),
        form(F.left(t, F.floor(F.length(t) / 2).cast("int")), b, 0, (k != EMAIL) & (k != SECRET)),
        form(F.concat(F.lit("999"), t), b, 0, (k == IP) & t.rlike("^[0-9.]+$")),
        form(plain, b, 0, k == SECRET),
        form(t, F.lit("see version "), 0, (k == IP) | (k == CARD)),
        form(F.regexp_replace(t, r"^\+", ""), F.lit("order no. "), 0, k == PHONE),
    ]
    return F.filter(F.array(*made), lambda v: v.isNotNull())


def examples(spans: DataFrame) -> DataFrame:
    """Distinct feature vectors with their counts (n0, n1 to fit, c0, c1 to set thresholds), from all spans."""
    good = F.concat(*[F.filter(f"_base{k}", base_rule(k)) for k in BASE], F.filter(candidates(), lambda x: (x["k"] >= ID) & strict(x)))
    each = spans.select(F.explode(good).alias("x")).withColumn("h", F.xxhash64("x.k", "x.t", "x.b", "x.a"))
    rows = each.select(F.explode(variants(F.col("x"))).alias("v"), (F.pmod("h", F.lit(4)) == 0).alias("apart"))
    rows = rows.select(features(F.col("v")).alias("f"), "v.label", "apart")
    count = lambda apart, label: F.sum(((F.col("apart") == apart) & (F.col("label") == label)).cast("long"))
    return rows.groupBy("f").agg(count(False, 0).alias("n0"), count(False, 1).alias("n1"), count(True, 0).alias("c0"), count(True, 1).alias("c1"))


#: A tree: (feature, bin) of the first cut, and for each side (feature, bin, leaf at most, leaf above).
Tree = tuple[int, int, tuple[int, int, float, float], tuple[int, int, float, float]]
LAST = 1 << 30


def leaf_sum(trees: list[Tree], f: Column) -> Column:
    """The margin of a vector of bins: the sum of the leaves that it falls into.  Trees go along as one constant."""
    rows = [{"f": t[0], "b": t[1]} | {f"{n}{i}": v for i, side in enumerate(t[2:]) for n, v in zip("fblh", side, strict=True)} for t in trees]
    kind = "array<struct<f:int,b:int,f0:int,b0:int,l0:double,h0:double,f1:int,b1:int,l1:double,h1:double>>"
    data = F.from_json(F.lit(json.dumps(rows)), F.lit(kind))

    def add(total: Column, t: Column) -> Column:
        side = lambda i: F.when(F.get(f, t[f"f{i}"]) <= t[f"b{i}"], t[f"l{i}"]).otherwise(t[f"h{i}"])
        return total + F.when(F.get(f, t["f"]) <= t["b"], side(0)).otherwise(side(1))

    return F.aggregate(data, F.lit(0.0), add)


Sums = tuple[float, float]


def best_cut(cells: list[tuple[int, int, float, float]]) -> tuple[int, int, Sums, Sums]:
    """(feature, bin, sums at most, sums above) of the best cut of a histogram of (feature, bin, gradient, weight); without one all is at most."""
    worth = lambda g, h: g * g / (h + RIDGE)
    total = (sum(g for f, _, g, _ in cells if f == 0), sum(h for f, _, _, h in cells if f == 0))
    best, most = (0, LAST, total, (0.0, 0.0)), 1e-9
    for feature in range(len(FEATURES)):
        g = h = 0.0
        for b, dg, dh in sorted((b, dg, dh) for f, b, dg, dh in cells if f == feature)[:-1]:
            g, h = g + dg, h + dh
            gain = worth(g, h) + worth(total[0] - g, total[1] - h) - worth(*total)
            if gain > most:
                best, most = (feature, b, (g, h), (total[0] - g, total[1] - h)), gain
    return best


#: A counted example: bins, fitted with label 0 and 1, kept apart with label 0 and 1.
Counted = tuple[list[int], int, int, int, int]


def margin(trees: list[Tree], f: list[int]) -> float:
    total = 0.0
    for feature, at, *sides in trees:
        inner, cut, low, high = sides[f[feature] > at]
        total += low if f[inner] <= cut else high
    return total


def boost(table: list[Counted], rounds: int = ROUNDS) -> list[Tree]:
    """Trees for the logistic loss over counted feature vectors, as a rule a few hundred whatever the number of examples."""
    trees: list[Tree] = []
    rows = [(f, n0 + n1, n1) for f, n0, n1, _, _ in table if n0 + n1]
    margins = [0.0] * len(rows)
    leaf = lambda s: SHRINK * s[0] / (s[1] + RIDGE)
    for _ in range(rounds):
        chance = [1 / (1 + math.exp(-m)) for m in margins]

        def histogram(feature: int, at: int, above: bool, chance: list[float] = chance) -> list[tuple[int, int, float, float]]:
            cells: dict[tuple[int, int], list[float]] = {}
            for (f, n, n1), p in zip(rows, chance, strict=True):
                if (f[feature] > at) == above:
                    for key in enumerate(f):
                        cell = cells.setdefault(key, [0.0, 0.0])
                        cell[0] += n1 - n * p
                        cell[1] += n * p * (1 - p)
            return [(*key, *cell) for key, cell in cells.items()]

        feature, at, *_ = best_cut(histogram(0, LAST, False))
        if at == LAST:
            break
        sides = []
        for above in (False, True):
            inner, cut, low, high = best_cut(histogram(feature, at, above))
            sides.append((inner, cut, leaf(low), leaf(high)))
        trees.append((feature, at, *sides))
        margins = [m + margin(trees[-1:], f) for m, (f, _, _) in zip(margins, rows, strict=True)]
    return trees


def thresholds(table: list[Counted], trees: list[Tree], precision: float = PRECISION) -> dict[int, float]:
    """For each kind the lowest margin above which the examples kept apart are true at ``precision``."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        own = sorted(((round(margin(trees, f), 3), c0, c1) for f, _, _, c0, c1 in table if f[0] == kind and c0 + c1), reverse=True)
        bad = good = 0
        for k, (m, c0, c1) in enumerate(own):
            bad, good = bad + c0, good + c1
            tied = k + 1 < len(own) and own[k + 1][0] == m
            if not tied and m > 0 and good >= precision * (bad + good):
                out[kind] = m - 0.0005
    return out


Model = tuple[list[Tree], dict[int, float]]


def train(documents: DataFrame) -> Model:
    """Trees and thresholds from the texts' own strict spans; without any the model selects nothing."""
    table = sorted(tuple(r) for r in examples(with_spans(documents.select(F.coalesce("text", F.lit("")).alias("text")))).collect())
    trees = boost(table)
    return trees, thresholds(table, trees)


def chosen(model: Model, base: Column) -> Column:
    """Candidates over their threshold that touch no base span; of those that touch each other the one with the larger margin, then the first."""
    trees, least = model
    if not trees or not least:
        return F.array().cast("array<struct<k:int,s:int,e:int>>")

    def judged(x: Column) -> Column:
        f = features(x)
        limit = F.lit(math.inf)
        for kind, at in least.items():
            limit = F.when(x["k"] == kind, F.lit(at)).otherwise(limit)
        # the bins are computed once for each candidate
        m = F.element_at(F.transform(F.array(f), lambda v: leaf_sum(trees, v)), 1)
        return F.struct(x["s"].alias("s"), (-m).alias("m"), x["e"].alias("e"), x["k"].alias("k"), (m >= limit).alias("yes"))

    good = F.filter(F.transform(candidates(), judged), lambda x: x["yes"])
    inside = lambda x: F.exists(base, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))
    free = F.array_sort(F.filter(good, lambda x: ~inside(x)))
    kept = "array<struct<k:int,s:int,e:int,m:double>>"

    def sweep(out: Column, x: Column) -> Column:
        new = F.array(F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
        last = F.element_at(out, -1)
        apart = (F.size(out) == 0) | (x["s"] >= F.when(F.size(out) > 0, last["e"]).otherwise(0))
        return F.when(apart, F.concat(out, new)).when(x["m"] < last["m"], F.concat(F.slice(out, 1, F.size(out) - 1), new)).otherwise(out)

    return F.transform(F.aggregate(free, F.array().cast(kept), sweep), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind and start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans_of(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, spans): arrays of (k, s, e), the base spans and all spans; start and end in code points, end exclusive."""
    rows = with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    valid = F.concat(*[F.filter(f"_base{k}", base_rule(k)) for k in BASE])
    with_base = rows.withColumn("_base", F.transform(valid, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return with_base.select("doc_id", F.col("_base").alias("base"), F.concat("_base", chosen(model, F.col("_base"))).alias("spans"))


def personal_data(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each document: n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts count as empty: no spans, and the hash of the empty string.  Null and
    repeated ids keep a row each; texts of any length are read whole; an empty table
    gives no rows.  Other columns are not read.
    """
    found = spans_of(documents, model or train(documents))

    def of(kind: int) -> Callable[[Column], Column]:
        return lambda x: x["k"] == kind

    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redacted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; other columns, ids and null texts stay.

    The pieces between merged spans are cut from the text in order.
    """
    model = model or train(documents)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    rows = with_spans(documents.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in documents.columns]).alias("_record"), F.coalesce("text", F.lit("")).alias("text")))
    valid = F.concat(*[F.filter(f"_base{k}", base_rule(k)) for k in BASE])
    rows = rows.withColumn("_base", F.transform(valid, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    order = F.array_sort(F.transform(F.concat("_base", chosen(model, F.col("_base"))), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("m"), x["k"].alias("k"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def more(acc: Column, x: Column) -> Column:
        piece = F.when(x["s"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1))).otherwise("")
        return F.struct(F.greatest(acc["at"], -x["m"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    made = F.aggregate(order, zero, more, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.col("_record.text").isNotNull(), made)
    return rows.select(*[(text if c == "text" else F.col("_record").getField(c)).alias(c) for c in documents.columns])
