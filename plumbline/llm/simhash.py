"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into ``SEGMENTS`` segments.  Two fingerprints that differ
in at most ``MAX_BITS`` bits differ in at most ``MAX_BITS // SEGMENTS`` bits
within some segment, so small Hamming balls around each segment, looked up in a
table of segments, find every such pair; whole distances are then compared.
Only distinct fingerprints take part, so equal texts cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, tidy, whole_id, written

SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 2
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    one = xxhash.xxh64_intdigest
    h = np.array([one(flat[s:e], SEED) for s, e in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(_id, fp) for every row; a null text counts as empty, a null doc_id as the smallest long."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fps)], ["_id", "fp"])

    return documents.select(whole_id("doc_id").alias("_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "_id long, fp long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(src, dst) for pairs of distinct fingerprints ``fp`` that differ in at most max_bits bits.

    Probes only set bits (a pair that differs within a segment by one bit is
    found from the side where it is 0; with larger balls, from the side with
    the smaller segment, or from either).
    """
    width, radius = 64 // segments, max_bits // segments
    mask = (1 << width) - 1
    flips = [0, *(sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(width), r))]
    seg = F.array(*[F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit(mask)) for s in range(segments)])
    table = distinct.select("fp", F.posexplode(seg).alias("s", "key"))
    probes = table.select("s", F.col("fp").alias("src"), F.col("key").alias("own"), F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    if radius == 1:
        probes = probes.where("(own & flip) = 0")
    probes = probes.select("s", "src", F.expr("own ^ flip").alias("key"), "flip")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits
    found = probes.join(table.withColumnRenamed("fp", "dst"), ["s", "key"]).where(near & F.when(F.col("flip") == 0, F.col("src") < F.col("dst")).otherwise(F.lit(True)))
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, keeper) for every row of ``documents``.

    component_id is the smallest doc_id of all documents reachable over links,
    itself included; keeper says whether the row is the one that stays: its own
    doc_id is component_id.  Null and empty texts share fingerprint 0 and link
    like others.  Rows that repeat a doc_id are linked by their texts alone; a
    null doc_id counts as the smallest.  Other columns are not read.
    """
    each = written(fingerprints(documents, shingle), "fingerprints")
    first = each.groupBy("fp").agg(F.min("_id").alias("first"))
    distinct = written(first, "distinct")
    member = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(member, distinct.fp == member.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    classes = named.join(least, "component").select("fp", "least")
    out = each.join(classes, "fp")
    smallest = F.lit(-(1 << 63))
    return out.select(
        F.when(F.col("_id") != smallest, F.col("_id")).alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("least") != smallest, F.col("least")).alias("component_id"),
        (F.col("_id") == F.col("least")).alias("keeper"),
    )
