"""Structured row predicates.

A predicate is a plain tuple, so that callers can build it from request parameters without writing SQL text::

    ("and", ("eq", "dept", "HR"), ("not", ("contains", "name", "x")), ("ne", "mail", None))
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import wall_clock

COMPARISONS = {"eq": eq, "ne": ne, "gt": gt, "ge": ge, "lt": lt, "le": le}
TEXT_TESTS = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}
CONNECTIVES = {"and": and_, "or": or_}


def typed_literal(value: object, data_type: T.DataType) -> Column:
    """A literal of the column's own type where the caller gave text, so that the filter still reaches the scan."""
    if isinstance(value, uuid.UUID):
        return F.lit(str(value))
    if isinstance(data_type, T.TimestampNTZType):
        return wall_clock(value)
    if isinstance(value, str) and not isinstance(data_type, T.StringType):
        return F.lit(value).cast(data_type)
    return F.lit(value)


def predicate(df: DataFrame, spec: tuple) -> Column:
    """Turn a predicate tuple into a Column over ``df``."""
    op, *args = spec
    if op in CONNECTIVES:
        return reduce(CONNECTIVES[op], [predicate(df, part) for part in args])
    if op == "not":
        return ~predicate(df, args[0])

    name, value = args
    column = F.col(name)
    if op in TEXT_TESTS:
        return TEXT_TESTS[op](column, F.lit(value))
    if op not in COMPARISONS:
        raise ValueError(f"unknown predicate operator {op!r}")
    if value is None:
        if op == "eq":
            return column.isNull()
        if op == "ne":
            return column.isNotNull()
        raise ValueError(f"operator {op!r} cannot compare {name!r} with null")
    return COMPARISONS[op](column, typed_literal(value, df.select(name).schema[0].dataType))
