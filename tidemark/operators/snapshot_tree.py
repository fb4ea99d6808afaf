"""A tree of digests over the parts of a snapshot, and comparison of snapshots that descends only where digests differ.

A leaf is the digest of all rows of a part, whatever files they lie in; a node above is the digest of its ``FANOUT``
children in order.  Two snapshots with the same parts are compared from the top: of each level only children of nodes
that differ are looked at, and in the end only files of parts that differ are read, less the files that both share.

A digest joins two 64-bit hashes of every row by exclusive or, beside the number of rows.  Rows of parts whose digests
differ are compared value by value; equal digests of different parts are as unlikely as equal 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.changes import delta_between
from tidemark.session import cut_lineage

if TYPE_CHECKING:
    from tidemark.sources.parts import PartTable

FANOUT = 16


def height(parts: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while FANOUT**levels < parts:
        levels += 1
    return levels


def tree_of(manifest: DataFrame, parts: int) -> DataFrame:
    """Rows ``level``, ``node``, ``rows``, ``digest`` for every part and node that holds rows, from one manifest."""
    level = manifest.groupBy(F.col("_part").cast("bigint").alias("node")).agg(
        F.sum("rows").alias("rows"), F.bit_xor("digest1").alias("_1"), F.bit_xor("digest2").alias("_2")
    )
    level = level.select(F.lit(0).alias("level"), "node", "rows", F.sha2(F.concat_ws("/", "rows", "_1", "_2"), 256).alias("digest"))
    tree = level
    for k in range(1, height(parts) + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most FANOUT
        level = level.groupBy(F.floor(F.col("node") / FANOUT).alias("_up")).agg(
            F.sum("rows").alias("rows"), F.sha2(F.to_json(children), 256).alias("digest")
        )
        level = level.select(F.lit(k).alias("level"), F.col("_up").alias("node"), "rows", "digest")
        tree = tree.unionByName(level)
    return tree


def changed_nodes(old: DataFrame, new: DataFrame, top: int) -> list[DataFrame]:
    """Nodes that differ between two trees, one DataFrame for each level from the root down."""
    found: list[DataFrame] = []
    for level in range(top, -1, -1):
        sides = [t.where(F.col("level") == level).select("node", "digest") for t in (old, new)]
        if found:
            above = found[-1].select(F.col("node").alias("_up"))
            sides = [s.join(above, F.floor(F.col("node") / FANOUT) == F.col("_up"), "left_semi") for s in sides]
        before, after = (s.withColumnRenamed("digest", n) for s, n in zip(sides, ("_old", "_new"), strict=True))
        differ = before.join(after, "node", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
        found.append(cut_lineage(differ.select("node")))
        if found[-1].isEmpty():
            break
    return found


def changed_parts(old: PartTable, new: PartTable) -> list[int]:
    """Numbers of the parts whose rows differ, at most all of them."""
    if (old.parts, old.by, old.keys) != (new.parts, new.by, new.keys) or old.schema.names != new.schema.names:
        raise ValueError("snapshots with other parts, keys or columns have no digests in common")
    nodes = changed_nodes(old.tree, new.tree, height(new.parts))
    return sorted(r.node for r in nodes[-1].collect()) if len(nodes) == height(new.parts) + 1 else []


def differing_files(old: PartTable, new: PartTable) -> tuple[Sequence[str], Sequence[str]]:
    """The files of either snapshot that a comparison has to read."""
    parts = changed_parts(old, new)
    before, after = (set(t.files(parts)) if parts else set() for t in (old, new))
    shared = before & after if old.path == new.path else set()
    return sorted(before - shared), sorted(after - shared)


def tree_delta(old: PartTable, new: PartTable) -> DataFrame:
    """:func:`delta_between` of two snapshots, reading only what :func:`differing_files` names."""
    before, after = differing_files(old, new)
    return delta_between(old.read(before), new.read(after), list(new.keys))
