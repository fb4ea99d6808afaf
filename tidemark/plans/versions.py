"""Tables in parts: batches that rewrite touched files, and snapshots compared by their trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.operators.snapshot_tree import tree_delta
from tidemark.plans.registry import Tables, query
from tidemark.plans.sync import CLASSIFIED, MERGED, TARGET_SQL, _snapshots, _source, _target
from tidemark.session import work_path
from tidemark.sources.parts import PartTable, apply_batch, create

PARTS = 32


def _table(df: DataFrame) -> PartTable:
    return create(df, work_path(df.sparkSession, "table"), ["id"], PARTS)


def _upserted(t: Tables) -> tuple[PartTable, PartTable]:
    """The event registry before and after the batch of orders."""
    before = _table(_target(t))
    return before, apply_batch(before, _source(t), lambda rows, batch: merge.merge_upsert(rows, batch, ["id"]), "orders")


@query(
    "touched_upsert",
    f"WITH {TARGET_SQL} {MERGED} t.deleted FROM target t FULL JOIN source s ON t.id = s.id",
)
def touched_upsert(t: Tables) -> DataFrame:
    return _upserted(t)[1].read()


@query(
    "touched_delete",
    f"""
    WITH {TARGET_SQL} {MERGED} t.deleted FROM target t FULL JOIN source s ON t.id = s.id
    WHERE coalesce(s.id, t.id) NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    """,
)
def touched_delete(t: Tables) -> DataFrame:
    """Finished orders leave the version that the upsert has made; a repeated batch changes nothing more."""
    dead = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"))

    def change(rows: DataFrame, batch: DataFrame) -> DataFrame:
        return merge.delete_by_key(rows, batch, ["id"])

    after = apply_batch(_upserted(t)[1], dead, change, "finished")
    return apply_batch(after, dead, change, "finished").read()


@query("tree_delta", f"{CLASSIFIED} WHERE _state <> 'Unchanged'")
def tree_delta_of_snapshots(t: Tables) -> DataFrame:
    """Two snapshots that were written apart, compared by their trees of digests."""
    return tree_delta(*map(_table, _snapshots(t)))


@query(
    "tree_delta_of_versions",
    f"""
    WITH {TARGET_SQL}, merged AS ({MERGED} t.deleted FROM target t FULL JOIN source s ON t.id = s.id)
    SELECT m.*, CASE WHEN t.id IS NULL THEN 'Created' ELSE 'Updated' END AS _state
    FROM merged m LEFT JOIN target t ON m.id = t.id
    WHERE t.id IS NULL OR NOT (m.label IS NOT DISTINCT FROM t.label AND m.lines IS NOT DISTINCT FROM t.lines
                               AND m.seen_at IS NOT DISTINCT FROM t.seen_at)
    """,
)
def tree_delta_of_versions(t: Tables) -> DataFrame:
    """What a batch has changed, from the two versions of the table."""
    return tree_delta(*_upserted(t))
