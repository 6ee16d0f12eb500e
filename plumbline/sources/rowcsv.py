"""Delimited files as all-string DataFrames with ``__row__``, in exact record order.

One file is read by many tasks: a job scans ranges of its bytes for where
records begin (``splits``), and the data source ``rowcsv`` then reads each range
from its first record on.  Records that are too long are dropped and counted by
that scan, with messages for the first 20; short ones are padded with nulls, blank
lines skipped.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import config
from ..functions.text import unformula
from . import splits
from .sniff import SAMPLE_BYTES, Dialect, sniff

ROW = "__row__"
EXTENSIONS = (".csv", ".tsv", ".txt")
#: Bytes of a range; large files get larger ones, so that there are at most MOST_RANGES.
RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
LONE_RETURN = re.compile(rb"\r(?![\n]|$)")


def head_of(path: str) -> bytes:
    with splits.opened(path) as f:
        return f.read(SAMPLE_BYTES)


def files_of(path: str) -> list[str]:
    """The files of a folder in order of their names (hidden ones and marks of writers left out), or the one file."""
    place = Path(path.removeprefix("file:"))
    if "://" not in path and place.is_dir():
        return [str(f) for f in sorted(place.iterdir()) if f.is_file() and not f.name.startswith((".", "_"))]
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        if system.get_file_info(name).type == fs.FileType.Directory:
            start = path[: -len(name)] if path.endswith(name) else path.split("://")[0] + "://"
            return sorted(start + f.path for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and not f.base_name.startswith((".", "_")))
    return [path]


class RowCsv(DataSource):
    """``spark.read.format("rowcsv")``: ``__row__`` and the columns of one file, or of the files of a folder, all strings.

    Register it once by ``spark.dataSource.register(RowCsv)``.  Options: ``path``;
    ``encoding``, ``delimiter``, ``header_row`` (sniffed where missing); ``parts``: JSON
    of [file, begin, stop, records before, rows of earlier files], as ``read_csv`` finds them, else each
    file is one partition, and rows of the k-th file (from 0) count from k * 2**40.
    The schema is the header's; a given schema with fewer columns leaves the other cells
    unread.  With ``pushdown`` true (Spark then asks for ``spark.sql.python.filterPushdown.enabled``)
    comparisons with constants are applied before a record becomes a row.
    """

    @classmethod
    def name(cls) -> str:
        return "rowcsv"

    def dialect(self) -> Dialect:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError("the folder holds no file")
        shown = next((f for f in files if splits.size_of(f)), files[0])
        given = sniff(head_of(shown), self.options.get("encoding"), self.options.get("delimiter"))
        if "header_row" in self.options:
            given.header_row = int(self.options["header_row"])
        return given

    def schema(self) -> StructType:
        return StructType([StructField(ROW, LongType()), *[StructField(c, StringType()) for c in self.dialect().columns]])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteringReader if self.options.get("pushdown", "").lower() == "true" else RowCsvReader
        return kind(dict(self.options), schema, self.dialect())


class Part(InputPartition):
    """Records of a file from one byte to another, how many come before in it (its header included), and how many rows in earlier files."""

    def __init__(self, file: str, begin: int, stop: int, before: int, shift: int):
        self.file, self.begin, self.stop, self.before, self.shift = file, begin, stop, before, shift


#: What a filter asks of a value, as SQL does: nothing is true of a missing one.
TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


class RowCsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType, dialect: Dialect):
        self.options, self.names, self.dialect = options, schema.names, dialect
        if unknown := [n for n in self.names if n != ROW and n not in dialect.columns]:
            raise ValueError(f"the file has no column {unknown[0]}")
        self.tests: list[tuple[str, str, object]] = []

    def partitions(self) -> list[InputPartition]:
        if given := self.options.get("parts"):
            return [Part(*p) for p in json.loads(given)]
        return [Part(f, 0, splits.size_of(f), 0, k << 40) for k, f in enumerate(files_of(self.options["path"]))]

    def fits(self, record: dict[str, object]) -> bool:
        for kind, name, wanted in self.tests:
            x = record[name]
            if kind == "IsNull":
                good = x is None
            elif kind == "IsNotNull":
                good = x is not None
            else:
                good = x is not None and next(t for k, t in TESTS.items() if k.__name__ == kind)(x, wanted)
            if not good:
                return False
        return True

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        d, width = self.dialect, len(self.dialect.columns)
        wanted = [(n, None if n == ROW else d.columns.index(n)) for n in self.names]
        schema = pa.schema([(n, pa.int64() if n == ROW else pa.string()) for n in self.names])
        held: list[list] = [[] for _ in wanted]
        size = 0
        n = partition.before - d.header_row - 1
        for cells in splits.records(partition.file, partition.begin, partition.stop, d.encoding, d.delimiter):
            if n >= 0 and len(cells) <= width:
                values = [partition.shift + n + d.header_row + 2 if k is None else (cells[k] or None) if k < len(cells) else None for _, k in wanted]
                if not self.tests or self.fits(dict(zip(self.names, values, strict=True))):
                    for column, v in zip(held, values, strict=True):
                        column.append(v)
                    size += sum(map(len, cells))
                    if len(held[0] if held else ()) == BATCH_ROWS or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(held, schema, strict=True)], schema=schema)
                        held, size = [[] for _ in wanted], 0
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(held, schema, strict=True)], schema=schema)


class FilteringReader(RowCsvReader):
    """Takes comparisons with constants over from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.names or type(f) not in (*TESTS, IsNull, IsNotNull):
                yield f
            else:
                self.tests.append((type(f).__name__, name, getattr(f, "value", None)))


@dataclass
class CsvDataset:
    """A read file: its dialect, its rows with ``__row__`` (the header's line is 1 past the preamble), its number of records,
    how many were too long and dropped, and messages on the first of these."""

    dialect: Dialect
    df: DataFrame
    records: int
    too_long: int = 0
    messages: list[str] = field(default_factory=list)

    def dropped(self) -> int:
        return self.too_long


def ranges_of(path: str, encoding: str, range_bytes: int) -> list[tuple[str, int, int]]:
    size = splits.size_of(path)
    # line breaks of two bytes in other encodings, and lone carriage returns, are left to one task
    fit = splits.splittable(encoding) and not LONE_RETURN.search(head_of(path))
    step = max(range_bytes, -(-size // MOST_RANGES)) if fit else max(size, 1)
    return [(path, at, min(size, at + step)) for at in range(0, size, step)]


def scanned(spark: SparkSession, files: list[str], dialect: Dialect, range_bytes: int) -> tuple[list[list], int, int, list[str]]:
    """(parts for ``rowcsv``, records after the headers, too long ones, messages), from one job over all ranges of the files.

    The driver holds a few numbers for each range, of which a file has at most MOST_RANGES.
    """
    encoding, delimiter, width = dialect.encoding, dialect.delimiter, len(dialect.columns)

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = splits.scan(file, start, stop, encoding, delimiter, width)
                yield pa.RecordBatch.from_pydict({"file": [file], "stop": [stop], "cases": [json.dumps([c and vars(c) for c in both])]})

    ranges = [r for f in files for r in ranges_of(f, encoding, range_bytes)]
    if not ranges:
        return [], 0, 0, []
    jobs = spark.createDataFrame(ranges, "file string, start long, stop long").repartition(min(len(ranges), 4 * spark.sparkContext.defaultParallelism))
    found: dict[str, list] = {f: [] for f in files}
    for r in jobs.mapInArrow(cases, "file string, stop long, cases string").collect():
        found[r["file"]].append((r["stop"], *[c and splits.Case(**c) for c in json.loads(r["cases"])]))
    parts, total, wide, messages = [], 0, 0, []
    for file in files:

        def open_width(at: int, file: str = file) -> int:
            return len(next(splits.records(file, at, at + 1, encoding, delimiter), []))

        own, n, too_wide, first = splits.follow(sorted(found[file], key=lambda r: r[0]), open_width, width)
        skipped = dialect.header_row + 1
        parts += [[file, *p, total] for p in own]
        data = [(i, w) for i, w in first if i >= skipped]
        wide += too_wide - len(first) + len(data)
        messages += [f"record {i + 1} of {Path(file).name}: {w} cells, expected {width}" for i, w in data]
        total += max(0, n - skipped)
    return parts, total, wide, messages[: splits.MESSAGES]


def read_csv(spark: SparkSession, path: str, sample_above: int | None = None, range_bytes: int = RANGE_BYTES, whole: bool = False) -> CsvDataset:
    """Read one delimited file, or a folder of them with the same header; values are cleaned.

    The dialect is sniffed.  Files of more than ``sample_above`` rows (None: none) are
    sampled by stride.  In a folder, ``__row__`` goes on from file to file, and files of no
    byte hold no record (Spark's writers leave one for an empty first task).  With ``whole``
    each file is one value of Spark's own reader and one task, for stores that
    neither a path nor pyarrow reaches.
    """
    if whole:
        return read_whole(spark, path, sample_above)
    files = files_of(path)
    if not all(f.lower().endswith(EXTENSIONS) for f in files) or not files:
        raise ValueError("give a .csv, .tsv or .txt file")
    if not (filled := [f for f in files if splits.size_of(f)]):
        raise ValueError(f"the file {Path(files[0]).name} is empty")
    files = filled
    dialect = sniff(head_of(files[0]))
    parts, total, wide, messages = scanned(spark, files, dialect, range_bytes)
    spark.dataSource.register(RowCsv)
    read = spark.read.format("rowcsv").options(path=path, encoding=dialect.encoding, delimiter=dialect.delimiter, header_row=dialect.header_row, parts=json.dumps(parts)).load()
    df = read.select(ROW, *[unformula(F.col("`" + c.replace("`", "``") + "`")).alias(c) for c in dialect.columns])
    return CsvDataset(dialect, df if sample_above is None else systematic(df, sample_above), total, wide, messages)


def read_whole(spark: SparkSession, path: str, sample_above: int | None = None) -> CsvDataset:
    files = spark.read.format("binaryFile").load(path)
    head = files.where("length > 0").select(F.substring("content", 1, SAMPLE_BYTES).alias("h")).first()
    dialect = sniff(bytes(head.h if head else b""))
    width = len(dialect.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                held, n = [], -1 - dialect.header_row
                for cells in splits.reader(io.StringIO(data.as_py().decode(dialect.encoding, errors="replace"), newline=""), dialect.delimiter):
                    if cells:
                        if n >= 0:
                            held.append((n, cells))
                        n += 1
                    if len(held) == BATCH_ROWS:
                        yield as_batch(held)
                        held = []
                yield as_batch(held)

    parsed = files.select("content").mapInArrow(run, "n long, cells array<string>, width int")
    seen = parsed.agg(F.count("*").alias("n"), F.count_if(F.col("width") > width).alias("wide")).first()
    cells = [unformula(F.nullif(F.get("cells", F.lit(k)), F.lit(""))).alias(name) for k, name in enumerate(dialect.columns)]
    df = parsed.where(F.col("width") <= width).select((F.col("n") + dialect.header_row + 2).alias(ROW), *cells)
    return CsvDataset(dialect, df if sample_above is None else systematic(df, sample_above), seen["n"], seen["wide"])


def as_batch(rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string())), pa.array([len(c) for _, c in rows], pa.int32())], ["n", "cells", "width"])


def systematic(df: DataFrame, above: int = config.MAX_ROWS_FULL, target: int = config.SAMPLE_TARGET_ROWS, rows: int | None = None, first: int = 2) -> DataFrame:
    """All rows up to ``above``; beyond, every Nth row of each chunk, the same ones at every run."""
    n = df.count() if rows is None else rows
    if n <= above:
        return df
    every = max(2, -(-n // target))
    return df.where(F.pmod(F.pmod(F.col(ROW) - first, F.lit(config.CHUNK_SIZE)), F.lit(every)) == 0)


def read_parquet(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A Parquet table with ``__row__``: a unique integer column, or the place in a table of one file."""
    df = spark.read.parquet(path)
    if key:
        return df.withColumn(ROW, F.col(key).cast("long"))
    if len(df.inputFiles()) > 1:
        raise ValueError("a table of several files needs a key that orders its rows")
    return df.select("*", (F.col("_metadata.row_index") + 1).alias(ROW))
