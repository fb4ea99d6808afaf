"""Writes into the platform tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators.changes import with_audit_columns
from tidemark.operators.merge import merge_upsert
from tidemark.schemas import conform, schema


def into_platform(
    target: DataFrame, rows: DataFrame, table: str, keys: Sequence[str], run_ts: object, user: str
) -> DataFrame:
    """The next snapshot of a platform table after an upsert of ``rows``, with its standard columns maintained.

    Rows are cast to the table's types; columns that they lack stay as they are in the target.  Created rows are stamped
    throughout, changed ones get a new stamp and version, equal ones keep theirs.
    """
    given = {c.lower() for c in rows.columns}
    staged = conform(rows, table).select([c for c in schema(table).names if c in given])
    merged = merge_upsert(conform(target, table), staged, keys, with_action=True)
    return with_audit_columns(merged, run_ts, user).select(schema(table).names)
