"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
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


def small_side(df: DataFrame, row_bytes: int, limit_bytes: int = 48 << 20) -> DataFrame:
    """A written table marked for broadcast if its counted rows, at twice their bare size, stay below the limit, else unmarked."""
    return F.broadcast(df) if 2 * df.count() * row_bytes <= limit_bytes else df


MANIFEST = "manifest.json"


def commit(spark: SparkSession, path: str, state: dict[str, Any]) -> None:
    """Makes ``state`` what ``committed`` gives for a folder, in one step: written beside, then renamed over the old one."""
    jvm, hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    place, beside = jvm.Path(f"{path}/{MANIFEST}"), jvm.Path(f"{path}/.{MANIFEST}-{uuid.uuid4().hex}")
    out = place.getFileSystem(hadoop).create(beside)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(place.toUri() if "://" in path or path.startswith("file:") else place.getFileSystem(hadoop).getUri(), hadoop).rename(beside, place, over)


def committed(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The last state that was committed for a folder, None before the first."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = jvm.Path(f"{path}/{MANIFEST}")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/{MANIFEST}").first()[0])


def deleted(spark: SparkSession, path: str) -> bool:
    """Deletes a folder in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
