"""Merkle manifest of a table: a tree of digests for each group of rows, and one tree over the groups.

H is the hex SHA-256 of its inputs one after the other, digests as hex text.  A leaf is H of the columns of a row, each
``-`` if null and else its number of UTF-8 bytes, ``:`` and its value.  The leaves of a group ascend by the order column;
while a group has several nodes, every ``fanout`` consecutive ones (the last run: fewer, even one) become their H.  What
remains is the group's subroot; the subroots, ordered by group (null first, else bytewise), give the root in the same way.

* Positions: leaves are range-partitioned by group and order, sorted and stored, so that a leaf knows its place among the
  rows of its task.  One row for each task and group is enough to turn that into its place in the group.
* A level is an equi-join of its nodes with themselves: a node looks for the siblings at the places that its own place
  gives, ``place ^ 1`` in a binary tree and the other slots of its run else.  Nodes at slot zero emit the parents.  All
  groups climb together, and each level is stored, so a lost executor repeats no level below.
* Proofs go down again: a node's proof is what stands left and right of it, followed by the proof of its parent.  Levels
  shrink by ``fanout``, so all joins of both ways together move a small multiple of the leaves, and never a text.

``proofs`` is the manifest: any row can be checked against the root with its own columns and its proof alone (``folded``).

Defined results: nulls of any column are ``-``, so a null and an empty text differ; rows with equal order and group are
ordered by leaf, and equal leaves by their place in the stored table, so roots do not depend on the order of the input;
an empty table has no rows and no root; other columns are ignored but those that the caller names in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ROW_BITS = 33  # of monotonically_increasing_id: the lower bits number the rows of a task
DOWN_LEVELS = 8  # levels of proofs in one plan


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(*map(field, columns))


def placed(nodes: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``tree`` (number of the group), ``place`` in it from 0, and its ``size``.

    ``order`` must tell any two rows apart, as it does with the column that ``stored`` adds.
    """
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    row = F.monotonically_increasing_id()
    ranged = nodes.repartitionByRange(*by).sortWithinPartitions(*by).select("*", row.alias("_row"))
    kept = cut_lineage(ranged)
    task = F.shiftrightunsigned("_row", ROW_BITS).alias("_task")
    kept = kept.select("*", task).withColumn("_at", F.col("_row") - F.shiftleft("_task", ROW_BITS))
    parts = kept.groupBy("_task", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One row for each task and group that meet: at most as many as there are tasks and groups together.
    one = Window.partitionBy(group)
    parts = parts.select(
        F.col("_task").alias("_t"),
        F.col(group).alias("_g"),
        (F.coalesce(F.sum("_n").over(one.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(one).alias("size"),
        (F.min(F.struct("_task", "_first")).over(one)).alias("_begin"),
    )
    # A group is numbered by where its first row lies in the order of all rows.
    tree = F.shiftleft(F.col("_begin._task"), ROW_BITS) + F.col("_begin._first")
    parts = parts.select("_t", "_g", "_shift", "size", tree.alias("tree"))
    met = (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g"))
    place = (F.col("_at") + F.col("_shift")).alias("place")
    return kept.join(parts, met).select(*nodes.columns, "tree", place, "size")


def slots(fanout: int) -> list[Column]:
    """Places of a node's siblings: the other slots of its run."""
    place = F.col("place")
    if fanout == 2:
        return [place.bitwiseXOR(F.lit(1))]
    slot = place % fanout
    return [place - slot + (slot + j) % fanout for j in range(1, fanout)]


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (tree, place, hash) with ``step``: the hashes left and right of each in its run, one after the other.

    A join for each sibling; where a run is too short there is none.
    """
    found = []
    for j, at in enumerate(slots(fanout)):
        other = nodes.select(
            F.col("tree").alias("_tree"), F.col("place").alias(f"_place{j}"), F.col("hash").alias(f"_hash{j}")
        )
        nodes = nodes.withColumn("_at", at)
        met = (F.col("tree") == F.col("_tree")) & (F.col("_at") == F.col(f"_place{j}"))
        nodes = nodes.join(other, met, "left").drop("_tree", "_at")
        found.append(F.struct(F.col(f"_place{j}").alias("p"), F.col(f"_hash{j}").alias("h")))
    run = F.array_sort(F.filter(F.array(*found), lambda s: s["p"].isNotNull()))

    def side(keep) -> Column:
        return F.aggregate(F.filter(run, keep), F.lit(b""), lambda a, s: F.concat(a, s["h"]))

    left, right = side(lambda s: s["p"] < F.col("place")), side(lambda s: s["p"] > F.col("place"))
    step = F.struct(left.alias("left"), right.alias("right")).alias("step")
    return nodes.select("*", step).drop(*(f"_{n}{j}" for n in ("place", "hash") for j in range(fanout - 1)))


def climbed(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """All stored levels of the trees, leaves first, and ``roots`` (tree, hash of the last node).

    Every level has the columns of its nodes, their ``size`` (nodes of the tree in the level) and ``step``.
    """
    levels, roots = [], []
    nodes, left = leaves, None
    while left is None or left > 1:
        levels.append(cut_lineage(with_siblings(nodes, fanout)))
        level = levels[-1]
        if left is None:
            left = level.agg(F.max("size")).first()[0] or 0
        else:
            left = -(-left // fanout)
        roots.append(level.filter("size = 1").select("tree", "hash"))
        # Trees of one node are done; the others go on with one node for each run.
        own = digest(hex_text(F.col("step.left")), hex_text(F.col("hash")), hex_text(F.col("step.right")))
        nodes = level.filter((F.col("size") > 1) & (F.col("place") % fanout == 0)).select(
            "tree",
            F.call_function("div", F.col("place"), F.lit(fanout).cast("bigint")).alias("place"),
            F.ceil(F.col("size") / fanout).alias("size"),
            F.unhex(own).alias("hash"),
        )
    return levels, reduce(DataFrame.unionByName, roots)


def lowered(levels: list[DataFrame], fanout: int) -> DataFrame:
    """The leaves with ``proof``: the steps of their nodes from the leaf up to below the root of the tree."""
    above = None
    for k, level in reversed(list(enumerate(levels))):
        # A node that is alone in its tree is the root and has no step of its own.
        own = F.when(F.col("size") > 1, F.array("step")).otherwise(F.array().cast(level.select(F.array("step")).schema[0].dataType))
        if above is None:
            down = level.withColumn("proof", own).drop("step")
        else:
            parent = F.call_function("div", F.col("place"), F.lit(fanout).cast("bigint"))
            higher = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("proof").alias("_proof"))
            joined = level.withColumn("_at", parent).join(
                higher, (F.col("tree") == F.col("_tree")) & (F.col("_at") == F.col("_place")) & (F.col("size") > 1), "left"
            )
            proof = F.when(F.col("_proof").isNull(), own).otherwise(F.concat(own, "_proof"))
            down = joined.withColumn("proof", proof).drop("step", "_tree", "_place", "_proof", "_at")
        above = cut_lineage(down) if k and k % DOWN_LEVELS == 0 else down
    return above


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest gives with the steps of its proof."""
    return F.aggregate(
        proof, start, lambda node, step: digest(hex_text(step["left"]), node, hex_text(step["right"]))
    )


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, from the leaf to the root and from left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(hex_text(s["left"]), hex_text(s["right"]))), ""))


def proofs(
    df: DataFrame,
    columns: Sequence[str],
    group: str = "lang",
    order: str = "doc_id",
    fanout: int = 2,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """The manifest: ``group``, ``id`` (the order column), ``keep``, ``leaf``, ``subroot``, ``root`` and ``proof``.

    ``proof`` has one struct (``left``, ``right``: binary, the digests of the siblings) for each node from the leaf to
    below the root, through the subroot.
    """
    kept = [c.alias(f"keep_{name}") for name, c in (keep or {}).items()]
    marked = df.select(
        F.col(group).alias("group"), F.col(order).alias("id"), F.unhex(leaf([F.col(c) for c in columns])).alias("hash"), *kept
    )
    # Stored, so that texts are read once and equal leaves have an order of their own.
    leaves = cut_lineage(marked.withColumn("tie", F.monotonically_increasing_id()))
    levels, subroots = climbed(placed(leaves, "group", ["id", "hash", "tie"]).drop("tie"), fanout)
    groups = levels[0].filter("place = 0").select("tree", "group").join(subroots, "tree")
    tops = groups.withColumn("all", F.lit(0)).withColumnRenamed("tree", "of")
    tops = placed(tops, "all", ["group"]).select("of", "tree", "place", "size", "hash")
    top_levels, root = climbed(cut_lineage(tops), fanout)
    top = lowered(top_levels, fanout).join(root.withColumnRenamed("hash", "root"), "tree")
    top = cut_lineage(top.select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("proof").alias("_top")))
    return (
        lowered(levels, fanout)
        .join(top, "tree")
        .select(
            "group",
            "id",
            *(F.col(f"keep_{name}").alias(name) for name in keep or {}),
            *(hex_text(F.col(c)).alias(name) for c, name in (("hash", "leaf"), ("subroot", "subroot"), ("root", "root"))),
            F.concat("proof", "_top").alias("proof"),
        )
    )
