"""Row keys: latest row per key, uniqueness, and rows whose key cannot match."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage


def has_key(keys: Sequence[str]) -> Column:
    """True when no key column is null; a null key never equals another one."""
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


APART = "_apart"


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with a further column to shuffle on: constant for rows with a key, a hash of the row for those without.

    Rows without a key match nothing; the column keeps them in the one pass over their input and still out of a
    single partition.  The hash holds the task's number, so that even equal rows spread, and a repeated task sends
    each row where its first attempt did.
    """
    if APART in df.columns:
        return df
    # Tables on both sides must keep this expression: a constant would be folded out of the join's keys.
    hashed = [f.name for f in df.schema.fields if not _unhashable(f.dataType)]
    own = F.xxhash64(*hashed, F.spark_partition_id())
    return df.withColumn(APART, F.when(has_key(keys), F.lit(0).cast("bigint")).otherwise(own))


def join_spread(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of a lookup side with one row per ``key``; the rows of ``df`` without a key spread over all tasks."""
    return spread(df, [key]).join(spread(lookup, [key]), [key, APART], "left").drop(APART)


def _unhashable(data_type: T.DataType) -> bool:
    """Maps and variants have no hash, nor has what contains them."""
    return "map<" in data_type.simpleString() or "variant" in data_type.simpleString()


def split_by_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can match and rows that cannot, for inputs that are cheap to read twice."""
    return df.where(has_key(keys)), df.where(~has_key(keys))


def latest_per_key(
    df: DataFrame, keys: Sequence[str], seq: str | Column | Sequence[str | Column]
) -> DataFrame:
    """The last row of each key by ``seq``; rows without a key are all kept.

    The rank filter lets Spark keep one row per key in every map task before the shuffle, so a key that holds a
    large share of the rows sends only one row per task.
    """
    return latest_apart(spread(df, keys), keys, seq).drop(APART)


def latest_apart(
    df: DataFrame, keys: Sequence[str], seq: str | Column | Sequence[str | Column]
) -> DataFrame:
    """:func:`latest_per_key` of spread rows, which stay partitioned and sorted for a join.

    Of equal sequence values one row is first by number; rows without a key have no order, so that all are first.
    """
    order = [seq] if isinstance(seq, str | Column) else list(seq)
    newest = [F.when(has_key(keys), F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]
    number = F.when(has_key(keys), F.monotonically_increasing_id())
    first = F.rank().over(Window.partitionBy(*keys, APART).orderBy(*newest, "_number"))
    return df.withColumn("_number", number).withColumn("_rank", first).where("_rank = 1").drop("_rank", "_number")


def require_unique(df: DataFrame, keys: Sequence[str], together: Sequence[str] = ()) -> DataFrame:
    """``df`` unchanged; the job fails when a key occurs twice.  Rows without a key pass.

    The check runs on the partitioning and sort order that a following join on the same columns needs anyway, or on
    ``together``: the keys and columns that they decide, in the order by which the rows are sorted next.
    """
    message = F.concat(F.lit("a key occurs twice in one batch: "), F.to_json(F.struct(*keys)))
    single = (F.col("_position") == 1) | ~has_key(keys)
    first = F.when(single, True).otherwise(F.raise_error(message).cast("boolean"))
    together = list(together) or ([*keys, APART] if APART in df.columns else list(keys))
    position = F.row_number().over(Window.partitionBy(*together).orderBy(*together))
    return df.withColumn("_position", position).where(first).drop("_position")


def rejected_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a keyed write cannot place, with ``reject_reason``: a key column is missing, or the key occurs twice.

    A run that has any counts as failed, see :mod:`tidemark.operators.sync`.
    """
    keyed, loose = split_by_key(df, keys)
    repeated = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    twice = keyed.join(repeated, list(keys), "left_semi").withColumn("reject_reason", F.lit("key occurs twice"))
    return loose.withColumn("reject_reason", F.lit("key missing")).unionByName(twice)


def one_change_per_key(df: DataFrame, keys: Sequence[str], is_delete: Column) -> DataFrame:
    """One change per key of an unordered batch: a deletion wins, two upserts of one key fail the job.

    The choice is an aggregate, so every map task sends one row per key; rows without a key are all kept.  Of several
    deletions of one key the row that is greatest by all its columns counts.  The batch is stored once, so that
    splitting it does not compute it twice.
    """
    keyed, loose = split_by_key(cut_lineage(df), keys)
    others = [c for c in df.columns if c not in keys]
    ordered = [F.to_json(c) if _unhashable(df.schema[c].dataType) else F.col(c) for c in others]
    once = keyed.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(is_delete, *ordered)).alias("_row"),
        F.bool_or(is_delete).alias("_deleted"),
        F.count_if(~is_delete).alias("_upserts"),
    )
    message = F.concat(F.lit("several upserts of one key in a batch: "), F.to_json(F.struct(*keys)))
    valid = F.when(F.col("_deleted") | (F.col("_upserts") == 1), True).otherwise(F.raise_error(message).cast("boolean"))
    return once.where(valid).select(*keys, "_row.*").unionByName(loose)
