"""Incremental upsert of an arriving change feed.

Every micro-batch is reduced to its latest change per key and written to its own folder, named by the streaming query and
the number of the batch, so the cost of a batch follows the batch and not the target, a replayed batch replaces what its
first attempt wrote, and a feed that starts over with a new checkpoint never meets the folders of an earlier one.

Reading merges the base with the changes that it does not contain.  A base keeps the sequence of its rows and the keys
that were deleted, so a change that arrives late loses or wins alike before and after a compaction.  Of changes of one
key the highest sequence decides, then a deletion, then the row that is greatest as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.keys import latest_per_key
from tidemark.operators.merge import CREATED, DELETED
from tidemark.sources.state import commit_state, load_state

STATE = ("stream_upsert", "base")


def _latest(changes: DataFrame, keys: Sequence[str], seq: str, state_col: str) -> DataFrame:
    """The change of each key that decides; every one of the order's parts is in the row itself."""
    deleted = F.col(state_col).eqNullSafe(DELETED)
    text = F.to_json(F.struct(*sorted(c for c in changes.columns if c not in ("feed", "batch_id"))))
    return latest_per_key(changes, keys, [F.col(seq), deleted, text])


def stream_upsert(
    changes: DataFrame,
    path: str,
    keys: Sequence[str],
    seq: str,
    checkpoint: str,
    state_col: str = "_state",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the upsert of a streaming change feed into ``path``; by default it drains the source and stops.

    ``changes`` carries the keys, the columns, a state column and the sequence column ``seq``.  The source's own
    options, such as ``maxFilesPerTrigger``, bound a batch.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        feed = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        latest = _latest(batch, keys, seq, state_col)
        latest.write.mode("overwrite").parquet(f"{path}/changes/feed={feed}/batch_id={batch_id}")

    return (
        changes.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_current(
    spark: SparkSession,
    path: str,
    schema: str,
    keys: Sequence[str],
    seq: str,
    base: DataFrame | None = None,
    state_col: str = "_state",
) -> DataFrame | None:
    """Current rows below ``path``, with their sequence: the compacted base, or ``base`` before the first compaction, and
    the changes that it does not contain.

    ``schema`` is that of the change feed.  Rows of ``base`` without a sequence are older than any change.
    """
    rows = _decided(spark, path, schema, keys, seq, base, state_col)
    return None if rows is None else rows.where(~F.col(state_col).eqNullSafe(DELETED)).drop(state_col)


def compact(
    spark: SparkSession,
    path: str,
    schema: str,
    keys: Sequence[str],
    seq: str,
    run_ts: object,
    base: DataFrame | None = None,
    state_col: str = "_state",
) -> None:
    """Write a new base of everything that has arrived; readers switch to it when its state row is committed.

    Every base has a folder of its own, so a base is never written over one that is being read.  Without changes since
    the last compaction nothing is written.
    """
    changes = _new_changes(spark, path, schema)
    through = None if changes is None else changes.groupBy("feed").agg(F.max("batch_id").alias("through")).collect()
    if not through:
        return
    folder = f"{path}/bases/{uuid.uuid4().hex}"
    # Batches that arrive from here on are left to the next compaction.
    bounds = spark.createDataFrame([tuple(r) for r in through], "feed string, through bigint")
    before = _contained(spark, path)
    contained = bounds if before is None else bounds.unionByName(before)
    contained = contained.groupBy("feed").agg(F.max("through").alias("through"))
    contained.coalesce(1).write.json(f"{folder}/contained")
    rows = _decided(spark, path, schema, keys, seq, base, state_col, bounds)
    rows.write.parquet(f"{folder}/rows")
    commit_state(spark, f"{path}/state", STATE[0], path, STATE[1], folder, run_ts)


def drop_contained(spark: SparkSession, path: str) -> None:
    """Delete the bases before the current one and the change folders that it contains; no reader may be using them."""
    current = _base_folder(spark, path)
    if current is None:
        return
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/bases")):
        if status.getPath().getName() != current.rsplit("/", 1)[1]:
            files.delete(status.getPath(), True)
    for feed, through in _contained(spark, path).collect():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/changes/feed={feed}")
        for status in files.listStatus(folder) if files.exists(folder) else []:
            name = status.getPath().getName()
            # The folder of the last batch stays: a query that replays it writes it again.
            if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) < through:
                files.delete(status.getPath(), True)


def _base_folder(spark: SparkSession, path: str) -> str | None:
    return load_state(spark, f"{path}/state", STATE[0], path, STATE[1])


def _contained(spark: SparkSession, path: str) -> DataFrame | None:
    """By feed, the last batch that the current base contains."""
    folder = _base_folder(spark, path)
    if folder is None:
        return None
    return spark.read.schema("feed string, through bigint").json(f"{folder}/contained")


def _new_changes(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Changes of batches that the current base does not contain; None before the first batch."""
    try:
        changes = spark.read.schema(f"{schema}, feed string, batch_id bigint").parquet(f"{path}/changes")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    contained = _contained(spark, path)
    if contained is None:
        return changes
    known = changes.join(contained, "feed", "left")
    return known.where(F.col("through").isNull() | (F.col("batch_id") > F.col("through"))).drop("through")


def _decided(
    spark: SparkSession,
    path: str,
    schema: str,
    keys: Sequence[str],
    seq: str,
    base: DataFrame | None,
    state_col: str,
    bounds: DataFrame | None = None,
) -> DataFrame | None:
    """The deciding row of each key with its state, deleted keys included; None before anything is there."""
    folder = _base_folder(spark, path)
    parts = []
    if folder is not None:
        parts.append(spark.read.schema(schema).parquet(f"{folder}/rows"))
    elif base is not None:
        parts.append(base.withColumn(state_col, F.lit(CREATED)))
    changes = _new_changes(spark, path, schema)
    if changes is not None and bounds is not None:
        changes = changes.join(bounds, "feed").where("batch_id <= through").drop("through")
    if changes is not None:
        parts.append(changes.drop("feed", "batch_id"))
    if not parts:
        return None
    empty = spark.createDataFrame([], schema)
    rows = empty
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return _latest(rows, keys, seq, state_col).select(*empty.columns)
