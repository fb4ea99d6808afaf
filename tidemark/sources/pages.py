"""Landed result pages of REST endpoints."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pages(pages: DataFrame, array_col: str = "value", item_schema: str | None = None) -> DataFrame:
    """One row per record of every page; an empty page gives none.

    The page array is a struct array, or JSON text with ``item_schema`` naming the fields to read from each record.
    Other page columns are repeated on the records.  No shuffle takes place.  A malformed page fails the job, because
    its records would be missing; :func:`split_pages` sorts such pages out.
    """
    others = [c for c in pages.columns if c != array_col]
    items = F.col(array_col)
    if isinstance(pages.schema[array_col].dataType, T.StringType):
        if item_schema is None:
            raise ValueError("JSON pages need an item_schema")
        items = F.from_json(items, f"array<struct<{item_schema}>>", {"mode": "FAILFAST"})
    return pages.select(*others, F.inline(items))


def split_pages(
    pages: DataFrame, array_col: str = "value", item_schema: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pages that can be read, and malformed ones with their ``reject_reason``; a run with any of these has failed.

    A page is malformed if its text is not a whole JSON array, and, with the ``item_schema`` that :func:`read_pages` gets,
    if one of its records is no object or a field has another type.  A null page has no records.
    """
    text = F.col(array_col)
    reason = F.when(F.json_array_length(text).isNull(), "page is not a JSON array")
    if item_schema is not None:
        # Only a struct can tell that a part of it could not be read.
        whole = F.concat(F.lit('{"v":'), text, F.lit("}"))
        read = F.from_json(whole, f"v array<struct<{item_schema}>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        reason = reason.when(read["_bad"].isNotNull(), "a record does not fit the schema")
    reason = F.when(text.isNotNull(), reason)
    return pages.where(reason.isNull()), pages.withColumn("reject_reason", reason).where("reject_reason IS NOT NULL")


def union_endpoints(endpoints: Mapping[str, DataFrame]) -> DataFrame:
    """Records of several endpoints in one stream, with the endpoint name; fields may differ."""
    named = [df.withColumn("endpoint", F.lit(name)) for name, df in endpoints.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def expand_relationships(
    df: DataFrame, member_col: str | None = None, nested: DataFrame | None = None, on: list[str] | None = None
) -> DataFrame:
    """One row per related object: from the member array of each entity, or by joining the nested extract."""
    if member_col is not None:
        others = [c for c in df.columns if c != member_col]
        return df.select(*others, F.explode(member_col).alias("member"))
    return df.join(nested, on)
