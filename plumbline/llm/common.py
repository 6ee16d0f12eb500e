"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SMALLEST = -(1 << 63)
#: Bytes of text that a task works on at a time (a longer document alone).
BUFFER = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where a local session names none (as in tests) a temporary folder is
    made and set; on a cluster that names none this raises ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-plumbline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Empties tables that ``written`` gave and that nothing reads any more: their space is free again."""
    for table in tables:
        files = table.inputFiles()
        if files:
            path = files[0].rsplit("/", 1)[0]
            table.limit(0).sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def small_side(df: DataFrame, row_bytes: int, limit_bytes: int = 48 << 20) -> DataFrame:
    """``df`` marked for broadcast if its counted rows, at twice their bare size, stay below the limit, else unmarked.

    Give a written table: the count reads only its footers.  Unmarked, a join
    shuffles both sides and splits skewed keys at run time.
    """
    return F.broadcast(df) if 2 * df.count() * row_bytes <= limit_bytes else df


def and_fields(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields, whatever the names of the first."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def whole_id(name: str) -> Column:
    """An integer id column as a long that is never null: null counts as the smallest long."""
    return F.coalesce(F.col(name).cast("long"), F.lit(SMALLEST))


def back_to_id(name: str) -> Column:
    return F.when(F.col(name) != SMALLEST, F.col(name))


def pieces(texts: list, size: int = BUFFER) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``size`` bytes (or characters) or so together; null counts as empty."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > size:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def named(column: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(documents: DataFrame) -> DataFrame:
    """(_id, _record): each row as a struct of its columns, whatever their names.

    ``_id`` is the row's doc_id (null: smallest long) or, where doc_ids repeat, a rank by doc_id, text and place.
    """
    record = F.struct(*[named(c) for c in documents.columns])
    docs = documents.select(whole_id("doc_id").alias("_id"), record.alias("_record"))
    if docs.groupBy("_id").count().where("count > 1").limit(1).count() == 0:
        return docs
    placed = docs.withColumns({"_text": F.col("_record.text"), "_place": F.monotonically_increasing_id()})
    order = ["_id", "_text", "_place"]
    ranked = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranked.select(F.monotonically_increasing_id().alias("_id"), "_record"), "ordered")


def once_each(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``_id`` is among few ids(_id, ...) and occurs once: as many as there are ids, at most."""
    few = F.broadcast(ids)
    single = rows.select("_id").join(few, "_id").groupBy("_id").count().where("count = 1").select("_id")
    return rows.join(F.broadcast(ids.join(single, "_id")), "_id")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most: what a task holds as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What a module's functions remember in a worker between tasks, and how to forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that first gives up what tasks of other modules remembered, and gives unused memory back to the
    system when it is done: workers outlive their tasks."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module, forget in REMEMBERED.items():
            if module != run.__module__:
                forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return inner


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs(_id, _record) whose ``_id`` is not among ids(_id), as they were; null-free ids."""
    return docs.join(small_side(written(ids, "ids"), 16), "_id", "left_anti").select("_record.*")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected graph ``edges(src long, dst long)``.

    Returns (node, component): every node of an edge with the smallest node it
    reaches.  Alternates large-star and small-star steps, each of which is a
    pre-aggregated minimum and a join that may split skewed nodes, until no
    edge changes.  Each round's edges are written to the shared folder.
    Raises RuntimeError if ``max_rounds`` do not suffice; empty in, empty out.
    """
    pairs = edges.where("src <> dst and src is not null and dst is not null")
    now = written(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        sign = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if sign == before:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = sign
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
