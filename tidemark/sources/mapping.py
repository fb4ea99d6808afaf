"""From source properties to target columns."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

PLACEHOLDER = re.compile(r"<%(.+?)%>")


def map_properties(df: DataFrame, mapping: Mapping[str, str | tuple[str, object] | None]) -> DataFrame:
    """Select target columns from source properties.

    A mapping value is a source column, None for the column of the same name, ``("lit", value)`` for a constant, or
    ``("template", "<%first%> <%last%>")`` for text with placeholders; a null property fills in as empty text.
    """

    def source(target: str, spec: str | tuple[str, object] | None) -> Column:
        if spec is None or isinstance(spec, str):
            return F.col(spec or target)
        kind, value = spec
        if kind == "lit":
            return F.lit(value)
        if kind != "template":
            raise ValueError(f"unknown mapping {kind!r}")
        pieces = PLACEHOLDER.split(str(value))  # literal text and property names alternate
        return F.concat(
            *[
                F.coalesce(F.col(piece).cast("string"), F.lit("")) if i % 2 else F.lit(piece)
                for i, piece in enumerate(pieces)
            ]
        )

    return df.select(*[source(target, spec).alias(target) for target, spec in mapping.items()])


def normalise_keys(df: DataFrame, map_col: str) -> DataFrame:
    """Lower-case the names of a property bag; of names that differ only in case the last one wins."""
    entries = F.map_entries(map_col)
    lowered = F.transform(
        entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    last = F.filter(
        lowered,
        lambda e, i: ~F.exists(F.slice(lowered, i + 2, F.size(lowered)), lambda later: later["key"] == e["key"]),
    )
    return df.withColumn(map_col, F.map_from_entries(last))


def align_to_target(df: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Columns both sides have, in target order and cast to the target types.

    A source column the target lacks is dropped with a warning; a missing key, or no common column, is an error.
    """
    by_name = {c.lower(): c for c in df.columns}
    in_target = {f.name.lower() for f in schema.fields}
    missing = [k for k in keys if k.lower() not in by_name or k.lower() not in in_target]
    if missing:
        raise ValueError(f"key columns missing: {', '.join(missing)}")
    common = [f for f in schema.fields if f.name.lower() in by_name]
    if not common:
        raise ValueError("no source column matches the target")
    dropped = sorted(c for c in by_name if c not in in_target)
    if dropped:
        log.warning("columns not in the target are skipped: %s", ", ".join(dropped))
    return df.select(*[F.col(by_name[f.name.lower()]).cast(f.dataType).alias(f.name) for f in common])


def ignore_case(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Compare these text columns without regard to case, as databases with a case-insensitive collation do.

    Filters, joins and merges on the columns follow; the text itself keeps its case.
    """
    return df.withColumns({c: F.collate(F.col(c), "UTF8_LCASE") for c in cols})


def typed_properties(df: DataFrame, json_col: str) -> DataFrame:
    """One row per top-level property of a JSON object, typed as text, int64 or decimal, boolean, null or raw JSON.

    A decimal comes as its exact text and as the nearest double.  A malformed object fails the job.
    """
    others = [c for c in df.columns if c != json_col]
    bag = F.from_json(json_col, "map<string,variant>", {"mode": "FAILFAST"})
    rows = df.select(*others, F.explode(bag).alias("property", "_value"))
    kind = F.schema_of_variant("_value")
    long_value = F.try_variant_get("_value", "$", "bigint")
    is_number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    is_long = kind == "BIGINT"
    is_raw = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return rows.select(
        *others,
        "property",
        F.when(kind == "VOID", "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(is_long, "long")
        .when(is_number, "decimal")
        .otherwise("raw")
        .alias("kind"),
        F.when((kind == "STRING") | is_raw, F.try_variant_get("_value", "$", "string")).alias("string_value"),
        F.when(is_long, long_value).alias("long_value"),
        F.when(is_number & ~is_long, F.try_variant_get("_value", "$", "string")).alias("decimal_text"),
        F.when(is_number & ~is_long, F.try_variant_get("_value", "$", "double")).alias("double_value"),
        F.when(kind == "BOOLEAN", F.try_variant_get("_value", "$", "boolean")).alias("boolean_value"),
    )
