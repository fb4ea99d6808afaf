"""Entity reads: filter, project, sort, page, count, and the row-visibility rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import predicate, typed_literal
from tidemark.operators.keys import _unhashable
from tidemark.session import cut_lineage


def sort_keys(order: Sequence[str | tuple[str, str]]) -> list[Column]:
    """Sort columns from ``"name"`` or ``("name", "desc")``; null sorts lowest, as in SQL Server."""
    keys = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        keys.append(F.desc_nulls_last(name) if direction.lower() == "desc" else F.asc_nulls_first(name))
    return keys


def entity_read(
    df: DataFrame,
    select: Sequence[str] | None = None,
    where: tuple | None = None,
    order: Sequence[str | tuple[str, str]] | None = None,
    top: int | None = None,
    skip: int | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Filter, project, sort and page rows; without a positive ``top`` all rows are returned.

    Sort plus limit compiles to one top-n operator, so no full sort takes place.  A deep ``skip`` still has to
    rank all skipped rows: use :func:`page_after` to walk a large table.  ``skip`` without ``top`` numbers the rows by
    ranges, so that no task sees all of them (:func:`skip_rows`).
    """
    out = df if where is None else df.where(predicate(df, where))
    if distinct:
        out = (out.select(*select) if select else out).distinct()
    if skip and skip > 0 and not (top and top > 0):
        out = skip_rows(out, order or [], skip)
        return out.select(*select) if select and not distinct else out
    if order:
        out = out.orderBy(*sort_keys(order))
    if select and not distinct:
        out = out.select(*select)
    if skip and skip > 0:
        out = out.offset(skip)
    return out.limit(top) if top and top > 0 else out


def skip_rows(df: DataFrame, order: Sequence[str | tuple[str, str]], skip: int) -> DataFrame:
    """All rows but the first ``skip`` in the given order, in that order; which of equal rows are skipped is open.

    Rows are dealt out by ranges of the sort columns, and stored with their number within their task; one row for each
    task says how many lie before it.  A hash of the row divides rows that the sort columns do not tell apart.
    """
    hashed = [f.name for f in df.schema.fields if not _unhashable(f.dataType)]
    keys = [*sort_keys(order), F.xxhash64(*hashed).asc()] if order else []
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    stored = cut_lineage(ranged.withColumn("_row", F.monotonically_increasing_id()))
    # The upper bits of the number are the task's, the lower 33 count its rows.
    stored = stored.withColumn("_task", F.shiftrightunsigned("_row", 33))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_row") - F.shiftleft("_task", 33) + F.col("_before")
    kept = stored.join(before, "_task").where(place >= skip).select(*df.columns)
    return kept.orderBy(*keys) if keys else kept


def page_after(
    df: DataFrame,
    order: Sequence[str | tuple[str, str]],
    after: Sequence[object] | None,
    top: int | None = None,
) -> DataFrame:
    """The ``top`` rows that follow the key values ``after``; the filter reaches the scan, so pages stay equally cheap.

    The sort columns must be together unique.  Nulls sort lowest, as in :func:`sort_keys`, and get onto pages like
    any other value.
    """
    if after is None:
        return entity_read(df, order=order, top=top)
    beyond = None
    for item, value in reversed(list(zip(order, after))):
        name, direction = (item, "asc") if isinstance(item, str) else item
        descending = direction.lower() == "desc"
        if value is None:
            step, same = (F.lit(False) if descending else F.col(name).isNotNull()), F.col(name).isNull()
        else:
            bound = typed_literal(value, df.select(name).schema[0].dataType)
            step, same = (F.col(name) > bound), F.col(name) == bound
            if descending:
                step = (F.col(name) < bound) | F.col(name).isNull()
        beyond = step if beyond is None else step | (same & beyond)
    return entity_read(df.where(beyond), order=order, top=top)


def next_page(page: DataFrame, top: int, skip: int = 0) -> DataFrame:
    """One row: rows on this page and the offset of the next one, null when this page was not full."""
    rows = F.count(F.lit(1))
    following = F.when(rows == top, F.lit(skip + top).cast("bigint"))
    return page.agg(rows.alias("rows"), following.alias("next_skip"))


def entity_count(
    df: DataFrame,
    where: tuple | None = None,
    deleted_col: str | None = None,
    include_deleted: bool = False,
) -> DataFrame:
    """Row count after the filter; soft-deleted rows count only on request."""
    out = df if where is None else df.where(predicate(df, where))
    if deleted_col and not include_deleted:
        out = live_rows(out, deleted_col)
    return out.agg(F.count(F.lit(1)).alias("count"))


def live_rows(df: DataFrame, deleted_col: str, sentinel: object = None) -> DataFrame:
    """Rows not soft-deleted: no deletion stamp, or the far-future ``sentinel`` where the table uses one."""
    live = F.col(deleted_col).isNull()
    if sentinel is not None:
        # An OR of two simple tests is pushed to the scan; a coalesce over the column would not be.
        live = live | (F.col(deleted_col) == typed_literal(sentinel, df.select(deleted_col).schema[0].dataType))
    return df.where(live)


def optional_filters(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Equality filters for the parameters that were given; a None parameter does not filter."""
    for name, value in values.items():
        if value is not None:
            df = df.where(predicate(df, ("eq", name, value)))
    return df


def search_any(df: DataFrame, cols: Sequence[str], text: str | None) -> DataFrame:
    """Rows in which any of the columns contains ``text`` literally."""
    if text is None:
        return df
    return df.where(reduce(or_, [F.contains(F.col(name), F.lit(text)) for name in cols]))


def find_by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this key."""
    return df.where(predicate(df, ("eq", key, value)))


def minimal_view(df: DataFrame, id_col: str, display_col: str = "display_name", fallback: str = "name") -> DataFrame:
    """Identifier and display name, with the fallback column where the table has no display name."""
    present = {name.lower() for name in df.columns}
    columns = [F.col(id_col).alias("id")]
    for candidate in (display_col, fallback):
        if candidate.lower() in present:
            columns.append(F.col(candidate).alias("display_name"))
            break
    return df.select(*columns)
