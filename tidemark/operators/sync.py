"""Full and delta synchronisation of a target snapshot from a source.

A run computes one join, stores its rows with what happened to each, and draws everything else from the stored rows:
counts, rejected rows, the guard against mass deletion, audit columns and the next snapshot.  A run with rejected rows
has failed: it publishes the target as it was and commits no state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import wall_clock
from tidemark.operators.keys import has_key
from tidemark.operators.merge import (
    CREATED,
    DELETED,
    action,
    apply_changes,
    merged_columns,
    needs_run_ts,
    outer_pairs,
    same_columns,
)
from tidemark.session import cut_lineage
from tidemark.sources.state import commit_state

DEFAULT_DELETE_PERCENTAGE = 10
REJECTED = "Rejected"


class DeletionThresholdExceeded(RuntimeError):
    """The run would delete a larger share of the target than allowed."""


class RowsRejected(RuntimeError):
    """The source has rows that cannot be placed."""


@dataclass
class Run:
    """Outcome of a run: ``rows`` are all rows of both sides with ``_action``, stored; ``counts`` is by action."""

    target: DataFrame
    rows: DataFrame
    counts: dict[str, int]
    hard: bool

    @property
    def failed(self) -> bool:
        return self.counts.get(REJECTED, 0) > 0

    @property
    def rejected(self) -> DataFrame:
        """Rows without a key, which the run could not place."""
        return self.rows.where(F.col("_action") == REJECTED).select(*self.target.columns)

    @property
    def merged(self) -> DataFrame:
        """The rows of the next snapshot with their ``_action``, for audit columns; none of a failed run."""
        gone = [REJECTED, DELETED] if self.hard else [REJECTED]
        return self.rows.where(~F.col("_action").isin(gone) & F.lit(not self.failed))

    @property
    def snapshot(self) -> DataFrame:
        """What to publish: the next snapshot, or the target as it was if the run has failed."""
        return self.target if self.failed else self.merged.select(*self.target.columns)

    def commit(self, spark: SparkSession, path: str, config: str, source: str, kind: str, value: str, at: object) -> None:
        """Append the run's state; a failed run leaves the previous one in force."""
        commit_state(spark, path, config, source, kind, value, at, had_errors=self.failed)


def _outcome(target: DataFrame, rows: DataFrame, hard: bool) -> Run:
    rows = cut_lineage(rows)
    counts = {r["_action"]: r["count"] for r in rows.groupBy("_action").count().collect()}
    return Run(target, rows, counts, hard)


def run_full_sync(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    percentage: float | None = DEFAULT_DELETE_PERCENTAGE,
    deleted_col: str | None = None,
    run_ts: object = None,
) -> Run:
    """A complete source scan: upsert what was seen, delete or stamp what was not.

    ``source`` holds one row per key, else the job fails.  Source rows without a key are rejected; target rows without
    one stay.  More deletions than ``percentage`` of the live target rows with a key stop the run (None: no limit).
    """
    needs_run_ts(deleted_col, run_ts)
    written = same_columns(target, source, keys)
    pairs = outer_pairs(target, source, keys)
    known, seen, keyed = F.col("_t").isNotNull(), F.col("_s").isNotNull(), has_key(keys)
    live = known & keyed
    columns = merged_columns(target, keys, written)
    if deleted_col is not None:
        stamped = F.col(f"_t.`{deleted_col}`")
        live = live & stamped.isNull()
        columns = [c for c, name in zip(columns, target.columns, strict=True) if name != deleted_col]
        stamp = F.when(seen, wall_clock(None)).when(live, wall_clock(run_ts)).otherwise(stamped)
        columns.append(stamp.alias(deleted_col))
        reinstated = known & seen & stamped.isNotNull()
    else:
        reinstated = F.lit(False)
    what = (
        F.when(seen & ~keyed, REJECTED)
        .when(live & ~seen, DELETED)
        .when(reinstated, "Updated")
        .otherwise(action(target, written))
    )
    rows = pairs.select(*columns, what.alias("_action"), live.alias("_live")).select(*target.columns, "_action", "_live")
    run = _outcome(target, rows, hard=deleted_col is None)
    deletions = run.counts.get(DELETED, 0)
    if percentage is not None and deletions and not run.failed:
        existing = run.rows.where("_live").count()
        if 100 * deletions > percentage * existing:
            raise DeletionThresholdExceeded(
                f"{deletions} of {existing} rows ({100 * deletions / existing:.2f} %) would be deleted, "
                f"allowed are {percentage} %"
            )
    return run


def full_sync(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    percentage: float | None = DEFAULT_DELETE_PERCENTAGE,
    deleted_col: str | None = None,
    run_ts: object = None,
) -> DataFrame:
    """The target after :func:`run_full_sync`; raises where rows were rejected."""
    return _published(run_full_sync(target, source, keys, percentage, deleted_col, run_ts))


def _published(run: Run) -> DataFrame:
    if run.failed:
        raise RowsRejected(f"{run.counts[REJECTED]} rows have no key")
    return run.snapshot


def run_delta_sync(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    seq: str | None = None,
    deleted_col: str | None = None,
    run_ts: object = None,
    small_batch: bool = False,
) -> Run:
    """A partial source read: apply what changed, never reconcile what is absent.  Changes without a key are rejected."""
    rows = apply_changes(target, changes, keys, deleted_col, run_ts, seq, with_action=True, small_batch=small_batch)
    without_key = ~has_key(keys) & (F.col("_action") == CREATED)
    rows = rows.withColumn("_action", F.when(without_key, REJECTED).otherwise(F.col("_action")))
    return _outcome(target, rows, hard=deleted_col is None)


def delta_sync(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    seq: str | None = None,
    deleted_col: str | None = None,
    run_ts: object = None,
    small_batch: bool = False,
) -> DataFrame:
    """The target after :func:`run_delta_sync`, computed lazily; changes without a key are inserted as a merge does."""
    return apply_changes(
        target, changes, keys, deleted_col=deleted_col, run_ts=run_ts, seq=seq, small_batch=small_batch
    )
