"""Language identification by fusing evidence with Bayes' rule.

For each text the posterior is proportional to the product of
 - the likelihood of its byte trigrams (trained here, tempered because trigrams
   of one text depend on each other),
 - the likelihood of the language that its markup declares,
 - the likelihood of the suffix of its address, and
 - the prior of its host, smoothed towards that of its domain, and that towards
   the share over everything.
Declarations, suffixes and priors come from grouped sums of the text's own
posteriors; a text's own part is taken out of its host's and domain's sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import and_fields, named, pieces, slices, small_side, written

#: Labelled texts of each language that the trigram model is fitted on, about.
FIT_ROWS = 1_000
SLOTS = 1 << 16
#: Languages whose trigram tables go to the tasks at a time.
SENT_LANGUAGES = 128
#: A text's evidence counts like that of this many trigrams at most.
TEMPER = 60.0
#: Weight of a domain in its host's prior, of everything in a domain's, and of the smoothing of declarations and suffixes.
HOST_WEIGHT, DOMAIN_WEIGHT, SIGN_WEIGHT = 5.0, 10.0, 2.0
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def slots_of(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)


def folded(text: bytes | None) -> bytes:
    return b" " + b" ".join((text or b"").translate(LETTERS).split()) + b" "


def tag_of(column: str) -> Column:
    """A language tag's first part in small letters, null if that has not two or three letters."""
    found = F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^\s*([A-Za-z]{2,3})\s*(?:$|[-_])", 1))
    return F.when(found != "", found)


def train(documents: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, all that rows with a text are labelled with, and log probabilities (SLOTS x languages) of trigrams.

    About ``rows`` texts of each language are counted, or all if it has fewer,
    chosen by the hash of their place; rare languages keep all theirs.  Tags
    count by their first part; without labelled rows there are no languages.
    """
    labelled = documents.select(tag_of("lang").alias("lang"), F.col("text").cast("binary").alias("t")).where("lang is not null and t is not null")
    sizes = {r.lang: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return langs, np.zeros((SLOTS, 0), np.float32)
    size = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(sizes[k]))])[F.col("lang")]
    picked = labelled.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), size) < rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list[int]] = {}
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                rows.setdefault(lang, []).append(k)
            for lang, own in rows.items():
                c = np.zeros(SLOTS, np.int64)
                for k in own:
                    c += np.bincount(slots_of(np.frombuffer(folded(batch.column("t")[k].as_py()), np.uint8)), minlength=SLOTS)
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "slot", "n"])

    found = picked.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # one row of at most SLOTS pairs for a language, one language at a time
    packed = found.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c"))
    table, place = np.full((SLOTS, len(langs)), 0.5, np.float32), {lang: k for k, lang in enumerate(langs)}
    for r in packed.toLocalIterator():
        pairs = np.array(r["c"], np.int64)
        table[pairs[:, 0], place[r["lang"]]] += pairs[:, 1]
    table /= table.sum(axis=0, dtype=np.float64).astype(np.float32)
    return langs, np.log(table, out=table)


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """rows with ``t`` (binary) and ``markup`` (boolean) replaced by ``n`` (trigrams of letters) and ``ll`` (array, tempered log-likelihoods).

    The tables of SENT_LANGUAGES languages at most (32 MB) go to the tasks at a time.
    """
    if table.shape[1] <= SENT_LANGUAGES:
        return evidence_of(rows, table)
    kept, parts = [c for c in rows.columns if c not in ("t", "markup")], []
    for at in range(0, table.shape[1], SENT_LANGUAGES):
        rows = evidence_of(rows, np.ascontiguousarray(table[:, at : at + SENT_LANGUAGES]), keep=True).withColumnRenamed("ll", f"_ll{at}").withColumnRenamed("n", f"_n{at}")
        parts.append(at)
    return rows.select(*[named(c) for c in kept], F.col("_n0").alias("n"), F.concat(*[F.col(f"_ll{at}") for at in parts]).alias("ll"))


def evidence_of(rows: DataFrame, table: np.ndarray, keep: bool = False) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in rows.columns if keep or c not in ("t", "markup")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in slices(batches):
            marks = batch.column("markup").to_pylist()
            texts = [folded(MARKUP.sub(b" ", t.as_py() or b"") if m else t.as_py()) for t, m in zip(batch.column("t"), marks, strict=True)]
            out = np.zeros((len(texts), table.shape[1]))
            sizes = np.array([len(t) - 2 for t in texts], np.int64)
            for a, b in pieces(texts):
                at = slots_of(np.frombuffer(b"".join([*texts[a:b], b"  "]), np.uint8))
                stops = np.cumsum([len(t) for t in texts[a:b]])
                edges = np.stack([stops - sizes[a:b] - 2, stops - 2], axis=1).ravel()  # a text's own trigrams, then those that reach into the next
                for k in range(table.shape[1]):
                    out[a:b, k] = np.add.reduceat(table[:, k][at], edges)[::2]
            n = np.maximum(sizes, 1)
            out = out / n[:, None] * np.minimum(n, TEMPER)[:, None]
            out[sizes <= 0] = 0
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.maximum(sizes, 0)), ll], [*kept, "n", "ll"])

    schema = and_fields(rows.select(*[named(c) for c in kept]).schema, "n long, ll array<double>")
    return rows.mapInArrow(run, schema)


def softmax(ll: np.ndarray) -> np.ndarray:
    powers = np.exp(ll - ll.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def summed(rows: DataFrame, by: list[str], array: str, name: str) -> DataFrame:
    """(by..., name): the sums of arrays of equal length, place by place, however many places there are."""
    places = rows.select(*by, F.posexplode(array).alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum("_v").alias("_v"))
    return places.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias(name))


def identify(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``lang``, ``probability`` and ``text_lang`` for rows(key..., t, markup, declared, host).

    ``t`` is the text or markup as bytes; ``declared`` a language tag or null;
    ``host`` a host or null.  Rows with neither letters nor a declaration get
    ``und`` with probability 0; a null host has the prior of everything.
    With one language all other rows are of it; without any all are ``und``.
    Empty tables give empty results; repeated rows get equal rows, whose
    evidence counts for each other's host as that of different rows does.
    """
    k = range(len(langs))
    keys = [c for c in rows.columns if c not in ("t", "markup", "declared", "host")]
    if not langs:
        return rows.select(*keys, F.lit("und").alias("lang"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_lang"))
    rows = rows.withColumns({
        "declared": F.coalesce(tag_of("declared"), F.lit("")),
        "domain": F.regexp_extract(F.coalesce("host", F.lit("")), r"([^.]+\.[^.]+)$|([^.]*)$", 0),
        "suffix": F.regexp_extract(F.coalesce("host", F.lit("")), r"\.([^.]+)$", 1),
        "host": F.coalesce("host", F.lit("")),
    })
    seen = text_evidence(rows, table)
    tops = seen.withColumns({"_top": F.array_max("ll")}).withColumn("_p", F.expr("transform(ll, x -> exp(x - _top))")).withColumn("_sum", F.expr("aggregate(_p, 0D, (a, b) -> a + b)"))
    q = F.when(F.col("n") > 0, F.expr("transform(_p, x -> x / _sum)")).otherwise(F.expr("transform(_p, x -> 0D)"))
    each = written(tops.withColumn("q", q).drop("_top", "_p", "_sum"), "evidence")
    size = 8 * len(langs)
    by_host = written(summed(each, ["host", "domain"], "q", "h"), "hosts")
    total = np.array((summed(by_host.withColumn("_all", F.lit(0)), ["_all"], "h", "t").first() or [0, [0.0] * len(langs)])[1])
    hosts = written(by_host.join(summed(by_host, ["domain"], "h", "d"), "domain").drop("domain"), "hosts")
    signs = [small_side(written(summed(each, [by], "q", name), by), 16 + size) for by, name in (("declared", "m"), ("suffix", "s"))]
    wide = hosts.agg(F.coalesce(F.max(F.octet_length("host")), F.lit(0))).first()[0]
    joined = each.join(small_side(hosts, 32 + wide + 2 * size), "host").join(signs[0], "declared").join(signs[1], "suffix")
    share, place = (total + 1) / (total.sum() + len(langs)), {lang: k for k, lang in enumerate(langs)}
    names = pa.array(langs)

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, (1 << 20) // len(langs))):
            ll, q, h, d, m, s = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs)) for c in ("ll", "q", "h", "d", "m", "s"))
            host, declared, suffix = (batch.column(c).to_pylist() for c in ("host", "declared", "suffix"))
            d, h = d - q, h - q
            domain = (d + DOMAIN_WEIGHT * share) / (d.sum(axis=1, keepdims=True) + DOMAIN_WEIGHT)
            of_host = (h + HOST_WEIGHT * domain) / (h.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            of_host[[x == "" for x in host]] = share
            logs = ll + np.log(np.maximum(of_host, 1e-9))
            match = np.full(ll.shape, 0.1)
            for row, tag in enumerate(declared):
                if tag in place:
                    match[row, place[tag]] += 0.9 / SIGN_WEIGHT
            for sums, expected, given in ((m, match, declared), (s, 0.1, suffix)):
                part = np.log(np.maximum((sums - q + SIGN_WEIGHT * expected) / (total + SIGN_WEIGHT), 1e-9))
                logs += np.where(np.array([x != "" for x in given])[:, None], part, 0.0)
            post, n = softmax(logs), batch.column("n").to_numpy(zero_copy_only=False)
            known = (n > 0) | np.array([x != "" for x in declared])
            best, by_text = (pa.compute.if_else(pa.array(w), names.take(pa.array(x.argmax(axis=1))), "und") for w, x in ((known, post), (n > 0, ll)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), best, pa.array(np.where(known, post.max(axis=1), 0.0)), by_text], [*keys, "lang", "probability", "text_lang"])

    return joined.mapInArrow(fused, and_fields(joined.select(*[named(c) for c in keys]).schema, "lang string, probability double, text_lang string"))


def languages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each document (doc_id; its source stands for the host) and page (page_id): lang, probability, text_lang.

    Documents have no address and no markup: text and source alone tell.  Null
    and empty texts are ``und``, null ids stay null, repeated ids are rows like
    others.  Columns besides those named here are not read.
    """
    langs, table = train(documents)
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("binary").alias("t"), F.lit(False).alias("markup"), F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    web = pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long").alias("page_id"),
        html.cast("binary").alias("t"),
        F.lit(True).alias("markup"),
        F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("declared"),
        F.nullif(F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1)), F.lit("")).alias("host"),
    )
    return identify(docs.unionByName(web), langs, table)
