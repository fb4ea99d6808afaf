"""Change detection between snapshots, shadow documents, audit columns and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import wall_clock
from tidemark.operators.keys import require_unique, spread
from tidemark.operators.merge import CREATED, DELETED, UNCHANGED, UPDATED, outer_pairs, same_value


def classify_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either snapshot with ``_state``; columns come from the new row, of deleted keys from the old one.

    Values are compared one by one, so the result does not depend on hashes.  A key that occurs twice in either
    snapshot fails the job.
    """
    values = [field for field in new.schema.fields if field.name not in keys]
    same = [same_value(f.name, f.dataType) for f in values]
    state = (
        F.when(F.col("_t").isNull(), CREATED)
        .when(F.col("_s").isNull(), DELETED)
        .when(reduce(and_, same, F.lit(True)), UNCHANGED)
        .otherwise(UPDATED)
    )
    kept = [
        F.when(F.col("_s").isNull(), F.col(f"_t.`{f.name}`")).otherwise(F.col(f"_s.`{f.name}`")).alias(f.name)
        for f in values
    ]
    before = require_unique(spread(old.select(*new.columns), keys), keys)
    return outer_pairs(before, new, keys).select(*keys, *kept, state.alias("_state"))


def delta_between(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The changes that lead from one snapshot version to the next."""
    return classify_changes(old, new, keys).where(F.col("_state") != UNCHANGED)


def change_summary(rows: DataFrame, state_col: str = "_action") -> DataFrame:
    """Row count per kind of change, from the rows of a run or of :func:`classify_changes`."""
    return rows.groupBy(F.col(state_col).alias("_state")).agg(F.count(F.lit(1)).alias("rows"))


def threshold_guard(rows: DataFrame, thresholds: Mapping[str, float], state_col: str = "_action") -> DataFrame:
    """One row per guarded operation: affected rows, existing rows, their percentage, and whether that is allowed.

    ``thresholds`` gives the highest allowed percentage of existing rows by state name.  One aggregation over the rows
    of a run, or of :func:`classify_changes`, counts all.
    """
    state = F.col(state_col)
    counts = rows.agg(
        F.count_if(state != CREATED).alias("existing"),
        *[F.count_if(state == name).alias(f"_{i}") for i, name in enumerate(thresholds)],
    )
    rows = []
    for i, (name, limit) in enumerate(thresholds.items()):
        affected = F.col(f"_{i}")
        percent = F.when(F.col("existing") == 0, 0.0).otherwise(F.try_divide(affected * 100.0, F.col("existing")))
        rows.append(
            F.struct(
                F.lit(name).alias("operation"),
                affected.alias("rows"),
                F.col("existing"),
                percent.alias("percent"),
                (percent <= limit).alias("allowed"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def shadow_snapshot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and the whole row as JSON with sorted property names, nulls left out."""
    values = [_ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    row = F.struct(*(value for _, value in sorted(zip(df.columns, values, strict=True), key=lambda pair: pair[0])))
    return df.select(*keys, F.to_json(row).alias("shadow_json"))


def _ordered(value: Column, data_type: T.DataType) -> Column:
    """A value with the entries of its maps in the order of their keys."""
    if isinstance(data_type, T.MapType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
        inner = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], data_type.valueType).alias("value")))
        return F.map_from_entries(inner)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, data_type.elementType))
    if isinstance(data_type, T.StructType):
        fields = [_ordered(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def with_audit_columns(df: DataFrame, run_ts: object, user: str, action_col: str = "_action") -> DataFrame:
    """Maintain inserted, updated and row version on merged rows that carry an action.

    Created rows are stamped throughout with version 1; updated rows get a new update stamp and the next version;
    unchanged rows keep theirs.
    """
    created = F.col(action_col) == CREATED
    touched = F.col(action_col).isin(CREATED, UPDATED)
    stamp = wall_clock(run_ts)

    def previous(name: str, data_type: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(data_type)

    version = F.coalesce(previous("row_version", "bigint"), F.lit(0).cast("bigint"))
    return df.withColumns(
        {
            "inserted": F.when(created, stamp).otherwise(previous("inserted", "timestamp_ntz")),
            "inserted_by": F.when(created, F.lit(user)).otherwise(previous("inserted_by", "string")),
            "updated": F.when(touched, stamp).otherwise(previous("updated", "timestamp_ntz")),
            "updated_by": F.when(touched, F.lit(user)).otherwise(previous("updated_by", "string")),
            "row_version": F.when(touched, version + 1).otherwise(version),
        }
    )


def purge_expired(
    df: DataFrame, inserted_col: str, deleted_col: str, as_of: object, days: int = 90
) -> DataFrame:
    """Drop rows that were inserted more than ``days`` before ``as_of`` and are soft-deleted."""
    cutoff = wall_clock(as_of) - F.make_dt_interval(F.lit(days))
    expired = (F.col(inserted_col) < cutoff) & F.col(deleted_col).isNotNull()
    return df.where(~F.coalesce(expired, F.lit(False)))
