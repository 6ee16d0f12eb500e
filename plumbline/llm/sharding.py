"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into buckets small enough for memory, by
seeded hashes; pass two shuffles each bucket by Fisher-Yates and writes it.
The buckets in order are one random permutation of all records; it is cut into
shards whose counts differ by one at most (the law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import and_fields, fresh_path, whole_id

SHARDS = 16
SEED = 20_240_501
#: Text bytes of a bucket, about; a bucket is the unit that has to fit in memory.
BUCKET_BYTES = 32 << 20
OWN = ("shard", "slot")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n): every place from the last swaps with one at or before it."""
    out = np.arange(n)
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else []
    for i, j in zip(range(n - 1, 0, -1), draws, strict=False):
        out[i], out[j] = out[j], out[i]
    return out


def shuffle_shards(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write ``documents`` into shards and return them as read back, with ``shard`` (int) and ``slot`` (long).

    Slots of a shard run from 0 without gaps, and files of a shard hold its
    records in runs of slots.  Every row is placed, whatever its columns hold:
    null or repeated ids and repeated rows are spread by their place in the
    input as well, so a hot key does not fill a bucket.  The placement depends
    on that place, so give a table or a frame read from one; the same files
    give the same shards.  Input columns named ``shard`` or ``slot`` give way.
    An empty table gives an empty one.  ``path`` defaults to a new folder in
    the shared folder.
    """
    spark = documents.sparkSession
    path = path or fresh_path(spark, "shards")
    names = [c for c in documents.columns if c not in OWN]
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    total = documents.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    buckets = max(4 * shards, -(-total // bucket_bytes))
    place = F.monotonically_increasing_id()
    where = F.pmod(F.xxhash64(F.lit(seed), whole_id("doc_id"), F.col("_place")), F.lit(buckets))
    placed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_record"), whole_id("doc_id").alias("doc_id"), place.alias("_place"))
    scattered = placed.select("_record", "_place", where.alias("_bucket"))
    counts = np.zeros(buckets, np.int64)  # a number for each bucket_bytes of input
    found = scattered.groupBy("_bucket").count().toArrow()
    counts[found.column("_bucket").to_numpy()] = found.column("count").to_numpy()
    rows = int(counts.sum())
    sent = spark.sparkContext.broadcast(np.cumsum(counts) - counts)
    long, extra = divmod(rows, shards)
    cuts = np.array([k * long + min(k, extra) for k in range(shards + 1)])

    def write(bucket: pa.Table) -> pa.Table:
        if not bucket.num_rows:
            return pa.table({"_record": bucket.column("_record"), "shard": pa.array([], pa.int32()), "slot": pa.array([], pa.int64())})
        b = bucket.column("_bucket")[0].as_py()
        order = np.argsort(bucket.column("_place").to_numpy(), kind="stable")
        order = order[fisher_yates(len(order), seed ^ b)]
        position = sent.value[b] + np.arange(len(order))
        shard = np.searchsorted(cuts, position, side="right") - 1
        return pa.table({"_record": bucket.column("_record").take(pa.array(order)), "shard": pa.array(shard, pa.int32()), "slot": pa.array(position - cuts[shard], pa.int64())})

    out = scattered.repartition(int(buckets), "_bucket").groupBy("_bucket").applyInArrow(write, and_fields(scattered.select("_record").schema, "shard int, slot long"))
    out.select("_record.*", *OWN).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    back = spark.read.schema(out.select("_record.*", "slot", "shard").schema).parquet(path)
    held = {r.shard: (r.n, r.top) for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    if any(held.get(k, (0, -1)) != (cuts[k + 1] - cuts[k], cuts[k + 1] - cuts[k] - 1) for k in range(shards)):
        raise RuntimeError("the input changed between two readings: give a table, or write the frame to one first")
    return back.select(*[F.col(f"`{c}`") for c in names], *OWN)


def digests(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every record, as read from its shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffle_shards(documents, shards).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
