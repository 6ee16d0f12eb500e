"""Catalogues of remote objects as DataFrames: what can be assessed, with which fields.

The remote calls themselves are left to whoever has credentials; these work on
what such calls describe, landed as JSON or Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Ends of names of system objects, and types of fields that hold no single value.
SYSTEM_ENDINGS = ("History", "Share", "Feed", "ChangeEvent", "__Tag", "__mdt", "__e", "__b", "__x", "__hd")
COMPOUND_TYPES = ("address", "location", "base64")


def _flag(name: str, default: bool = False) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def objects(described: DataFrame, counts: DataFrame, include_all: bool = False) -> DataFrame:
    """objects(name, label, queryable, retrieveable, deprecatedAndHidden, customSetting, layoutable, custom) that can
    be assessed, with their record counts(name, n) where known, ordered by label; hidden_count says how many are left out."""
    system = F.lit(False)
    for end in SYSTEM_ENDINGS:
        system = system | F.col("name").endswith(end)
    visible = ~_flag("deprecatedAndHidden") & ~_flag("customSetting") & _flag("layoutable") & ~system
    usable = described.where(_flag("queryable") & _flag("retrieveable", True)).withColumn("visible", visible)
    usable = usable.withColumn("hidden_count", F.count_if(~F.col("visible")).over(Window.partitionBy(F.lit(1)))) if not include_all else usable.withColumn("hidden_count", F.lit(0))
    shown = usable if include_all else usable.where("visible")
    label = F.coalesce(F.nullif("label", F.lit("")), "name")
    out = shown.join(counts.select("name", F.col("n").alias("record_count")), "name", "left")
    return out.select("name", label.alias("label"), _flag("custom").alias("custom"), "record_count", "hidden_count").orderBy(F.lower("label"), "name")


def fields(described: DataFrame) -> DataFrame:
    """The fields worth reading of described(object, position, name, label, type, custom, nillable, createable,
    defaultedOnCreate, deprecatedAndHidden, referenceTo, length, picklist array<struct<value,active>>), Id first."""
    fit = described.where(~F.coalesce("type", F.lit("")).isin(*COMPOUND_TYPES) & ~_flag("deprecatedAndHidden"))
    active = F.transform(F.filter("picklist", lambda p: F.coalesce(p["active"], F.lit(True))), lambda p: p["value"])
    order = Window.partitionBy("object").orderBy(F.col("name") != "Id", "position")
    return fit.select(
        "object",
        F.row_number().over(order).alias("position"),
        "name",
        F.coalesce(F.nullif("label", F.lit("")), "name").alias("label"),
        F.coalesce("type", F.lit("string")).alias("type"),
        _flag("custom").alias("custom"),
        (~_flag("nillable", True) & _flag("createable") & ~_flag("defaultedOnCreate")).alias("required"),
        "referenceTo",
        F.when(F.col("type").isin("picklist", "multipicklist"), active).alias("picklist"),
        F.nullif("length", F.lit(0)).alias("length"),
    )


def schema_of(rows: list[dict]) -> StructType:
    """An all-text schema with a field's label, type and the like as its metadata, from collected ``fields`` of one object."""
    return StructType([StructField(r["name"], StringType(), not r["required"], {k: r[k] for k in ("label", "type", "custom") if r.get(k) is not None}) for r in rows])


def projected(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Only the fields worth reading, in their order; nested values as JSON text (S12, F21), booleans as true and false."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*[(F.to_json(r["name"]) if kinds[r["name"]] in ("struct", "array", "map") else F.col(f"`{r['name']}`").cast("string")).alias(r["name"]) for r in rows if r["name"] in kinds])
