"""Schema inference: profile every property, then choose column types.

All statistics are sums, maxima and minima, so one partial and one final aggregation do the work and an entity type
that holds most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import has_unicode, length_bucket, utf16_length

FLAGS = ("boolean", "integer", "long", "double", "datetime", "guid", "bytes", "string")
DEFAULT_TYPE = "Default"


def _entity_type(by: str | None) -> Column:
    return F.coalesce(F.col(by).cast("string"), F.lit(DEFAULT_TYPE)) if by else F.lit(DEFAULT_TYPE)


def _flag_of(data_type: T.DataType, is_guid: bool) -> str:
    if is_guid:
        return "guid"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.ByteType | T.ShortType | T.IntegerType):
        return "integer"
    if isinstance(data_type, T.LongType):
        return "long"
    if isinstance(data_type, T.FractionalType):
        return "double"
    if isinstance(data_type, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "datetime"
    if isinstance(data_type, T.BinaryType):
        return "bytes"
    return "string"


def profile_properties(
    df: DataFrame,
    by: str | None = None,
    columns: Sequence[str] | None = None,
    guid_columns: Sequence[str] = (),
) -> DataFrame:
    """Profile of every column per entity type: one scan, one aggregation, one row per type and property.

    A column has one type, so at most three aggregates per column tell all: how many values, and the length and
    character range of text or the bounds of whole numbers.  Arrays, maps and structs are profiled as their JSON
    text.  Every row observes every column.
    """
    names = [c for c in (columns or df.columns) if c != by]
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, name in enumerate(names):
        data_type, value = df.schema[name].dataType, F.col(name)
        kind = _flag_of(data_type, name in guid_columns)
        measures = {"values": F.count(value)}
        if kind == "bytes":
            measures["length"] = F.max(F.octet_length(value))
        elif isinstance(data_type, T.StringType) and kind == "string":
            measures |= {"length": F.max(utf16_length(value)), "unicode": F.max(has_unicode(value))}
        elif kind == "string":
            measures["length"] = F.max(utf16_length(F.to_json(value)))
        elif kind in ("integer", "long"):
            measures |= {"low": F.min(value), "high": F.max(value)}
        aggregates += [measure.alias(f"{i}.{m}") for m, measure in measures.items()]

        def got(m: str, data_type: str, i: int = i, known: dict[str, Column] = measures) -> Column:
            return (F.col(f"`{i}.{m}`") if m in known else F.lit(None)).cast(data_type)

        found = got("values", "bigint") > 0
        rows.append(
            F.struct(
                F.lit(name).alias("property"),
                F.col("rows").alias("observations"),
                (F.col("rows") - got("values", "bigint")).alias("nulls"),
                F.coalesce(got("length", "int"), F.lit(0)).alias("max_length"),
                F.coalesce(got("unicode", "boolean"), F.lit(False)).alias("has_unicode"),
                *[(found if f == kind else F.lit(False)).alias(f"has_{f}") for f in FLAGS],
                got("low", "bigint").alias("min_integer"),
                got("high", "bigint").alias("max_integer"),
            )
        )
    return (
        df.groupBy(_entity_type(by).alias("entity_type"))
        .agg(*aggregates)
        .select("entity_type", F.inline(F.array(*rows)))
    )


def profile_bag(df: DataFrame, bag_col: str, by: str | None = None) -> DataFrame:
    """The same profile for an open property bag, a ``map<string,variant>`` or JSON object text.

    A property is observed only on rows that hold it; an explicit null counts as observed null.  Text that is no JSON
    object fails the job.
    """
    bag = F.col(bag_col)
    if isinstance(df.schema[bag_col].dataType, T.StringType):
        bag = F.from_json(bag, "map<string,variant>", {"mode": "FAILFAST"})
    entries = df.select(_entity_type(by).alias("entity_type"), F.explode(bag).alias("_key", "_value")).select(
        "entity_type", F.lower("_key").alias("property"), "_value", F.schema_of_variant("_value").alias("_kind")
    )
    kind = F.col("_kind")
    flags = {
        "boolean": kind == "BOOLEAN",
        "integer": F.lit(False),  # JSON whole numbers are 64-bit
        "long": kind == "BIGINT",
        "double": kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
        "datetime": kind.isin("TIMESTAMP", "TIMESTAMP_NTZ", "DATE"),
        "guid": kind == "UUID",
        "bytes": kind == "BINARY",
        "string": (kind == "STRING") | kind.startswith("ARRAY") | kind.startswith("OBJECT"),
    }
    # Each value is read once, as what it is, before the many aggregates use it.
    typed = entries.select(
        "entity_type",
        "property",
        "_kind",
        F.when(flags["string"], F.try_variant_get("_value", "$", "string")).alias("_text"),
        F.when(flags["long"], F.try_variant_get("_value", "$", "bigint")).alias("_number"),
        F.when(flags["bytes"], F.octet_length(F.try_variant_get("_value", "$", "binary"))).alias("_octets"),
    )
    text = F.col("_text")

    def seen(condition: Column) -> Column:
        return F.coalesce(F.max(condition), F.lit(False))

    return typed.groupBy("entity_type", "property").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(kind == "VOID").alias("nulls"),
        F.coalesce(F.max(F.coalesce("_octets", utf16_length(text))), F.lit(0)).alias("max_length"),
        seen((kind == "STRING") & has_unicode(text)).alias("has_unicode"),
        *[seen(flags[name]).alias(f"has_{name}") for name in FLAGS],
        F.min("_number").alias("min_integer"),
        F.max("_number").alias("max_integer"),
    )


def entity_types(df: DataFrame, by: str, profile: DataFrame) -> DataFrame:
    """Entity count and number of distinct properties per entity type."""
    counts = df.groupBy(_entity_type(by).alias("entity_type")).agg(F.count(F.lit(1)).alias("entities"))
    properties = profile.groupBy("entity_type").agg(F.count(F.lit(1)).alias("properties"))
    return counts.join(properties, "entity_type", "left").fillna(0, ["properties"])


def infer_columns(profile: DataFrame) -> DataFrame:
    """Column type, length, nullability and definition text for every profiled property.

    A flag outside the listed ones rules a type out: booleans may mix with numbers, text wins over all but bytes.
    """
    flag = {name: F.col(f"has_{name}") for name in FLAGS}

    def only(*allowed: str) -> Column:
        others = [flag[f] for f in FLAGS if f not in allowed and f != "bytes"]
        clear = F.lit(True)
        for other in others:
            clear = clear & ~other
        return clear

    whole = flag["integer"] | flag["long"]
    wide = (F.col("min_integer") < -(2**31)) | (F.col("max_integer") > 2**31 - 1)
    sql_type = (
        F.when(flag["bytes"], "VARBINARY")
        .when(flag["boolean"] & only("boolean"), "BIT")
        .when(flag["datetime"] & only("datetime", "boolean"), "DATETIME2")
        .when(flag["guid"] & only("guid", "boolean"), "UNIQUEIDENTIFIER")
        .when(whole & only("integer", "long", "boolean"), F.when(wide, "BIGINT").otherwise("INT"))
        .when(flag["double"] & only("double", "integer", "long", "boolean"), "FLOAT")
        .when(F.col("has_unicode"), "NVARCHAR")
        .otherwise("VARCHAR")
    )
    sized = F.col("sql_type").isin("VARBINARY", "NVARCHAR", "VARCHAR")
    bucket = F.when(sized, length_bucket(F.col("max_length")))
    return (
        profile.withColumn("sql_type", sql_type)
        .withColumn("column_length", bucket)
        .withColumn("is_nullable", (F.col("nulls") > 0) | (F.col("observations") == 0))
        .withColumn("definition", column_definition("property", "sql_type", "column_length", "is_nullable"))
    )


def column_definition(name: str, sql_type: str, length: str, nullable: str) -> Column:
    """Definition text ``[name] TYPE(length) NULL``; a sized type without a length is MAX."""
    size = F.concat(F.lit("("), F.coalesce(F.col(length).cast("string"), F.lit("MAX")), F.lit(")"))
    suffix = (
        F.when(F.col(sql_type).isin("VARBINARY", "NVARCHAR", "VARCHAR"), size)
        .when(F.col(sql_type) == "DATETIME2", "(7)")
        .otherwise("")
    )
    null_text = F.when(F.col(nullable), " NULL").otherwise(" NOT NULL")
    return F.concat(F.lit("["), F.col(name), F.lit("] "), F.col(sql_type), suffix, null_text)
