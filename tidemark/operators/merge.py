"""Keyed upsert, hard and soft delete on a target snapshot.

A target is a DataFrame; the result is the next snapshot, to be written to a new location.  Keys compare with ``=``,
so null keys never match: staged rows without a key are inserted, target rows without one stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import wall_clock
from tidemark.operators.keys import APART, has_key, latest_apart, one_change_per_key, require_unique, spread
from tidemark.session import cut_lineage

CREATED, UPDATED, DELETED, UNCHANGED = "Created", "Updated", "Deleted", "Unchanged"


def same_columns(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> list[str]:
    """Non-key staged columns; all of them and all keys must exist in the target."""
    present = set(target.columns)
    missing = [c for c in [*keys, *staged.columns] if c not in present]
    if missing:
        raise ValueError(f"target has no column {missing}; align the staged rows first")
    return [c for c in staged.columns if c not in keys]


def _packed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys and all other columns as one struct, which is null only where a join found no row."""
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys], F.lit(1).alias("_hit")).alias(name))


def outer_pairs(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    unique: bool = False,
    complete_keys: bool = False,
    small_batch: bool = False,
) -> DataFrame:
    """Target and staged rows side by side: keys, structs ``_t`` and ``_s`` (null when that side has no row).

    Each side is read once and shuffled once, on the keys; rows without a key spread out and stay unpaired.
    ``complete_keys`` says that no key is null, which spares the further shuffle column and so keeps the partitioning
    of bucketed snapshots.  ``small_batch`` stores the batch and pairs it with a left and an anti join, of which Spark
    broadcasts the batch by its measured bytes; the target is then read twice, the second time keys only.

    A staged key that occurs twice fails the job, unless the caller knows that keys are ``unique``.
    """
    on = list(keys)
    if not complete_keys:
        target, staged, on = spread(target, keys), spread(staged, keys), [*keys, APART]
    if not unique:
        staged = require_unique(staged, keys)
    if small_batch:
        return _small_pairs(target, cut_lineage(staged), on)
    return _packed(target, on, "_t").join(_packed(staged, on, "_s"), on, "full_outer")


def _small_pairs(target: DataFrame, staged: DataFrame, on: Sequence[str]) -> DataFrame:
    """The same pairs for a stored batch that Spark may find small enough to broadcast."""
    pairs = _packed(target, on, "_t").join(_packed(staged, on, "_s"), list(on), "left")
    found = target.select(*on).join(staged.select(*on), list(on), "left_semi")
    new = staged.join(found, list(on), "left_anti")
    return pairs.unionByName(_packed(new, on, "_s"), allowMissingColumns=True)


def merged_columns(target: DataFrame, keys: Sequence[str], written: Sequence[str]) -> list[Column]:
    """Target columns after the merge: a staged row overwrites the written columns, nulls included."""
    hit = F.col("_s").isNotNull()
    columns = []
    for name in target.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name in written:
            columns.append(F.when(hit, F.col(f"_s.`{name}`")).otherwise(F.col(f"_t.`{name}`")).alias(name))
        else:
            columns.append(F.col(f"_t.`{name}`").alias(name))
    return columns


def comparable(value: Column, data_type: T.DataType) -> Column:
    """A value in a form whose equality is that of the value: maps as sorted entries, variants as their JSON text."""
    if isinstance(data_type, T.VariantType):
        return F.to_json(value)
    if isinstance(data_type, T.MapType):
        entry = T.ArrayType(
            T.StructType([T.StructField("key", data_type.keyType), T.StructField("value", data_type.valueType)])
        )
        return F.sort_array(comparable(F.map_entries(value), entry))
    if isinstance(data_type, T.ArrayType) and _contains_loose(data_type.elementType):
        return F.transform(value, lambda x: comparable(x, data_type.elementType))
    if isinstance(data_type, T.StructType) and _contains_loose(data_type):
        fields = [comparable(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _contains_loose(data_type: T.DataType) -> bool:
    return "map<" in data_type.simpleString() or "variant" in data_type.simpleString()


def same_value(name: str, data_type: T.DataType) -> Column:
    """Whether a column is equal on both sides of :func:`outer_pairs`, two nulls being equal."""
    left, right = F.col(f"_t.`{name}`"), F.col(f"_s.`{name}`")
    return comparable(left, data_type).eqNullSafe(comparable(right, data_type))


def action(target: DataFrame, written: Sequence[str]) -> Column:
    """What the merge did to a row of :func:`outer_pairs`; a staged row equal to its target counts as unchanged."""
    same = reduce(and_, [same_value(name, target.schema[name].dataType) for name in written], F.lit(True))
    return (
        F.when(F.col("_t").isNull(), CREATED)
        .when(F.col("_s").isNull(), UNCHANGED)
        .when(same, UNCHANGED)
        .otherwise(UPDATED)
    )


def merge_upsert(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    with_action: bool = False,
    complete_keys: bool = False,
    small_batch: bool = False,
) -> DataFrame:
    """Update matching rows with every staged non-key column, insert the others, delete nothing.

    ``staged`` holds one row per key (see :func:`latest_per_key`), else the job fails.  With ``with_action`` the column
    ``_action`` tells what happened to each row.  ``complete_keys`` and ``small_batch`` as in :func:`outer_pairs`.
    """
    written = same_columns(target, staged, keys)
    if not written and not with_action:
        return insert_missing(target, staged, keys)
    pairs = outer_pairs(target, staged, keys, complete_keys=complete_keys, small_batch=small_batch)
    columns = merged_columns(target, keys, written)
    if with_action:
        columns.append(action(target, written).alias("_action"))
    return pairs.select(*columns)


def insert_missing(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert staged rows whose key the target lacks; matching rows stay untouched."""
    new = require_unique(spread(staged, keys), keys).join(_known(target, keys), [*keys, APART], "left_anti")
    return target.unionByName(new.drop(APART), allowMissingColumns=True)


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys to be joined with spread rows; those that are null spread as well and match nothing."""
    return spread(df.select(*keys), keys)


def delete_by_key(target: DataFrame, dead: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is not among the dead ones."""
    kept = spread(target, keys).join(_known(dead, keys), [*keys, APART], "left_anti")
    return kept.select(*target.columns)


def needs_run_ts(deleted_col: str | None, run_ts: object) -> None:
    """A soft delete without its time would leave the row live."""
    if deleted_col is not None and run_ts is None:
        raise ValueError("soft deletes need run_ts, the time of the run")


def stamp_deleted(df: DataFrame, deleted_col: str, run_ts: object, state_col: str = "_state") -> DataFrame:
    """Set the deletion column: the run time on rows reported deleted, null on all others, which reinstates them."""
    stamp = F.when(F.col(state_col) == DELETED, wall_clock(run_ts))
    return df.withColumn(deleted_col, stamp)


def apply_changes(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    deleted_col: str | None = None,
    run_ts: object = None,
    seq: str | None = None,
    state_col: str = "_state",
    with_action: bool = False,
    small_batch: bool = False,
) -> DataFrame:
    """Apply one batch of upserts and deletes.

    With ``seq`` the latest change of a key decides; equal or absent sequence values let the deletion win.  Without
    ``seq`` two upserts of one key are an error.  ``deleted_col`` switches to soft deletes stamped with ``run_ts``.
    With ``with_action`` the column ``_action`` tells what happened, and deleted rows stay in the result, so that counts
    and audit columns come from the same join; :func:`surviving` drops them.  ``small_batch`` as in :func:`outer_pairs`.
    """
    needs_run_ts(deleted_col, run_ts)
    is_delete = F.col(state_col).eqNullSafe(DELETED)
    if seq is None:
        batch = spread(one_change_per_key(changes, keys, is_delete), keys)
    else:
        batch = latest_apart(spread(changes, keys), keys, [F.col(seq), is_delete])

    if deleted_col is not None:
        batch = stamp_deleted(batch, deleted_col, run_ts, state_col)
    extra = {state_col, APART} | ({seq} if seq and seq not in target.columns else set())
    written = [c for c in batch.columns if c not in keys and c not in extra]
    same_columns(target, batch.drop(*extra), keys)

    pairs = outer_pairs(target, batch, keys, unique=True, small_batch=small_batch)
    gone = F.col(f"_s.`{state_col}`").eqNullSafe(DELETED)
    known = F.col("_t").isNotNull()
    if deleted_col is None:
        pairs = pairs.where(~gone | known) if with_action else pairs.where(~gone)
    columns = merged_columns(target, keys, written)
    if with_action:
        columns.append(F.when(gone & known, DELETED).otherwise(action(target, written)).alias("_action"))
    return pairs.select(*columns)


def surviving(rows: DataFrame) -> DataFrame:
    """The next snapshot from hard-deleting rows with their ``_action``."""
    return rows.where(F.col("_action") != DELETED).drop("_action")


def reconcile_deletes(
    target: DataFrame,
    seen: DataFrame,
    keys: Sequence[str],
    deleted_col: str | None = None,
    run_ts: object = None,
) -> DataFrame:
    """Delete, or stamp deleted, the target rows whose key a complete run did not see.

    Rows already stamped keep their stamp; rows without a key cannot be identified and stay.
    """
    needs_run_ts(deleted_col, run_ts)
    seen_keys = _known(seen, keys).distinct().withColumn("_seen", F.lit(True))
    marked = spread(target, keys).join(seen_keys, [*keys, APART], "left")
    unseen = has_key(keys) & F.col("_seen").isNull()
    if deleted_col is None:
        return marked.where(~unseen).select(*target.columns)
    stamp = F.when(unseen & F.col(deleted_col).isNull(), wall_clock(run_ts)).otherwise(F.col(deleted_col))
    return marked.withColumn(deleted_col, stamp).select(*target.columns)


def deletion_guard(
    target: DataFrame,
    seen: DataFrame,
    keys: Sequence[str],
    percentage: float,
    deleted_col: str | None = None,
) -> DataFrame:
    """One row: existing keys, keys to delete, their percentage, and whether that is allowed (not above the limit).

    Only key columns are read.  With ``deleted_col`` rows that are already soft-deleted do not count.
    """
    existing = target if deleted_col is None else target.where(F.col(deleted_col).isNull())
    existing_keys = existing.where(has_key(keys)).select(*keys)
    seen_keys = seen.select(*keys).distinct().withColumn("_seen", F.lit(1))
    counts = existing_keys.join(seen_keys, list(keys), "left").agg(
        F.count(F.lit(1)).alias("existing"),
        F.count_if(F.col("_seen").isNull()).alias("deletions"),
    )
    ratio = F.when(F.col("existing") == 0, 0.0).otherwise(F.try_divide(F.col("deletions") * 100.0, F.col("existing")))
    return counts.select("existing", "deletions", ratio.alias("percent"), (ratio <= percentage).alias("allowed"))
