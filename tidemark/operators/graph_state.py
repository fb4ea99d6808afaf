"""Inherited factors kept current: changes of edges and factors go through the graph, the rest of it stays as stored.

The state of a graph is three tables in parts: ``nodes`` with the best sums of walks of 1, 2, ... ``depth`` steps from
each node, and the live edges twice, by the node that a step leaves (``out``) and by the one that it enters (``into``).

A batch of changed nodes and edges is worked off level by level.  The best sum of k steps can only differ at nodes whose
own arcs have changed, and at nodes with an arc to one whose best sum of k-1 steps has changed.  Just these are computed,
from their arcs and the stored sums of the nodes behind them, and compared with what is stored; those that differ lead
to the next level.  Nodes that no arc enters lead nowhere: they are left out of the levels and get all their sums at
once from the finished sums of the nodes behind them, when the state is made as well as in a batch.  Only files of parts that hold such nodes, their arcs or the ends of these are opened, and only files
with nodes whose sums have changed are written anew.

Defined results: an edge is known by both ends and its type, and lives if any of its rows in one batch does; edges whose
end is no node take no part; a deleted node inherits 0 and passes nothing on; a changed node or edge comes as its new
row, a removed one as its row with ``deleted`` set.  An edge keeps the weight that its type had when the edge came.  A
batch that runs again after a failure finishes what is open; one that has been applied changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import DEFAULT_WEIGHT, MAX_DEPTH, _capped, _long
from tidemark.operators.merge import merge_upsert
from tidemark.session import cut_lineage
from tidemark.sources.parts import PartTable, apply_batch, create, has_batch, open_table

ARC = ["x", "y", "kind"]
NO_KIND = ""  # edges without a type


@dataclass(frozen=True)
class GraphState:
    nodes: PartTable
    out: PartTable
    into: PartTable

    @property
    def cols(self) -> list[str]:
        return [f for f in self.nodes.schema.names if f not in ("identifier", "live", "sums")]


def open_state(spark: SparkSession, path: str) -> GraphState:
    return GraphState(*(open_table(spark, f"{path}/{name}") for name in ("nodes", "out", "into")))


def _arc_rows(edges: DataFrame, edge_types: DataFrame, default_weight: int) -> DataFrame:
    """One row per edge identity: ``x, y, kind, weight`` and whether any of its rows lives."""
    weights = edge_types.select("edge_type_id", F.col("factor").cast("bigint").alias("weight"))
    once = edges.groupBy("node_to", "node_from", "edge_type_id").agg(F.bool_or(F.col("deleted").isNull()).alias("live"))
    return once.join(weights, "edge_type_id", "left").select(
        F.col("node_to").alias("x"),
        F.col("node_from").alias("y"),
        F.coalesce("edge_type_id", F.lit(NO_KIND)).alias("kind"),
        F.coalesce("weight", _long(default_weight)).alias("weight"),
        "live",
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _node_rows(nodes: DataFrame, cols: Sequence[str]) -> DataFrame:
    factors = [F.coalesce(F.col(c).cast("bigint"), _long(0)).alias(c) for c in cols]
    return nodes.select("identifier", F.col("deleted").isNull().alias("live"), *factors)


def _gain(col: str) -> Column:
    """What a step along an arc adds: the factor of the node that it enters, by the weight of the arc."""
    return F.call_function("div", F.col(col) * F.col("weight"), _long(100))


def _sums(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in cols])


def _none(cols: Sequence[str]) -> Column:
    return F.struct(*[_long(0).alias(c) for c in cols])


def _best(steps: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Best sums per ``x`` of steps that carry ``<col>_gain`` and, as ``onward``, the sums behind them."""
    totals = [_capped(F.max(F.col(f"{c}_gain") + F.coalesce(F.col(f"onward.{c}"), _long(0)))).alias(c) for c in cols]
    return steps.groupBy("x").agg(*totals).select("x", _sums(cols).alias("sums"))


def _best_of_levels(arcs: DataFrame, ends: DataFrame, cols: Sequence[str], depth: int) -> DataFrame:
    """``x`` and its best sums of 1 to ``depth`` steps, from the finished sums (``behind``, or null) of the ends of its arcs.

    ``ends`` has one row per node, much fewer than the arcs, which therefore go unsorted past a hash table of it.
    """
    gains = {c: _gain(c) for c in cols}
    steps = arcs.join(ends.hint("shuffle_hash"), "y").select(
        "x",
        *[
            (gains[c] + (F.coalesce(F.get("behind", F.lit(k - 2))[c], _long(0)) if k > 1 else _long(0))).alias(f"{c}_{k}")
            for k in range(1, depth + 1)
            for c in cols
        ],
    )
    best = steps.groupBy("x").agg(*[_capped(F.max(f)).alias(f) for f in steps.columns[1:]])
    levels = [F.struct(*[F.col(f"{c}_{k}").alias(c) for c in cols]) for k in range(1, depth + 1)]
    return best.select("x", F.array(*levels).alias("walked"))


def create_state(
    nodes: DataFrame,
    edges: DataFrame,
    edge_types: DataFrame,
    path: str,
    parts: int,
    cols: Sequence[str] = ("a_factor",),
    depth: int = MAX_DEPTH,
    default_weight: int = DEFAULT_WEIGHT,
) -> GraphState:
    """The state of a whole graph, from one computation of all levels."""
    cols = list(cols)
    live = edges.where(F.col("deleted").isNull() & F.col("node_to").isNotNull() & F.col("node_from").isNotNull())
    arcs = cut_lineage(_arc_rows(live, edge_types, default_weight).drop("live"))
    known = cut_lineage(_node_rows(nodes, cols))
    entered = arcs.select(F.col("y").alias("identifier")).distinct()
    ends = known.where("live").join(entered, "identifier", "left_semi")
    ends = cut_lineage(ends.select(F.col("identifier").alias("y"), *cols))
    through = arcs.join(ends.select(F.col("y").alias("x")).hint("shuffle_hash"), "x", "left_semi")
    steps = cut_lineage(through.join(ends, "y").select("x", "y", *[_gain(c).alias(f"{c}_gain") for c in cols]))
    levels: list[DataFrame] = []
    for _ in range(depth - 1):
        if levels:
            onward = steps.join(levels[-1].select(F.col("x").alias("y"), F.col("sums").alias("onward")), "y", "left")
        else:
            onward = steps.withColumn("onward", F.lit(None).cast(steps.select(_none(cols)).schema[0].dataType))
        levels.append(cut_lineage(_best(onward, cols)))
        # Sums only grow, so all further levels are like this one when it is like the one before.
        if len(levels) > 1 and levels[-1].join(levels[-2], ["x", "sums"], "left_anti").isEmpty():
            break
    if levels:
        rows = reduce(DataFrame.unionByName, [v.withColumn("level", F.lit(k)) for k, v in enumerate(levels, 1)])
        found = rows.groupBy(F.col("x").alias("y")).agg(F.map_from_entries(F.collect_list(F.struct("level", "sums"))).alias("_levels"))
        behind = F.transform(F.sequence(F.lit(1), F.lit(len(levels))), lambda k: F.coalesce(F.element_at("_levels", k), _none(cols)))
        ends = cut_lineage(ends.join(found, "y", "left").select("y", *cols, behind.alias("behind")))
    else:
        ends = ends.withColumn("behind", F.array(_none(cols)))
    last = len(levels) + 1
    walked = _best_of_levels(arcs, ends, cols, last).withColumnRenamed("x", "identifier")
    stored = F.transform(
        F.sequence(F.lit(1), F.lit(depth)),
        lambda k: F.coalesce(F.get("walked", F.least(k, F.lit(last)) - 1), _none(cols)),
    )
    table = known.join(walked, "identifier", "left").select("identifier", "live", *cols, stored.alias("sums"))
    return GraphState(
        create(table, f"{path}/nodes", ["identifier"], parts),
        create(arcs, f"{path}/out", ARC, parts, by=["x"]),
        create(arcs, f"{path}/into", ARC, parts, by=["y"]),
    )


def inherited(state: GraphState, col: str) -> DataFrame:
    """``(identifier, inherited)`` of every node, as :func:`tidemark.operators.graph.inherited_factor` gives it."""
    total = F.col(col) + F.element_at("sums", -1)[col]
    return state.nodes.read().select("identifier", F.when(F.col("live"), _capped(total)).otherwise(_long(0)).alias("inherited"))


def _replace_arcs(rows: DataFrame, batch: DataFrame) -> DataFrame:
    return rows.join(batch, ARC, "left_anti").unionByName(batch.where("live").drop("live"))


def _read_nodes(table: PartTable, changed: DataFrame, wanted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of the wanted nodes after the changes, with the sums stored before them (null for new nodes), and whether
    they are ``changed``."""
    values = ["live", *cols]
    new = changed.join(wanted, "identifier", "left_semi").select("identifier", F.struct(*values).alias("_new"))
    hit = F.col("_new").isNotNull()
    rows = table.lookup(wanted).join(new, "identifier", "full_outer")
    after = [F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return rows.select("identifier", *after, "sums", hit.alias("changed"))


def _overlaid(rows: DataFrame, levels: Sequence[DataFrame], key: str, depth: int, cols: Sequence[str]) -> DataFrame:
    """``rows`` with their stored ``sums``, in which those of the levels that differ take their places, as ``kept``."""
    # At most one row per node and level.
    found = reduce(DataFrame.unionByName, [v.select("x", "sums", F.lit(k).alias("level")) for k, v in enumerate(levels, 1)])
    entries = F.map_from_entries(F.collect_list(F.struct("level", "sums"))).alias("_levels")
    kept = F.transform(
        F.sequence(F.lit(1), F.lit(depth)),
        lambda k: F.coalesce(F.element_at("_levels", k), F.get("sums", k - 1), _none(cols)),
    )
    found = found.groupBy(F.col("x").alias(key)).agg(entries)
    return rows.join(found, key, "left").withColumn("kept", kept).withColumn("moved", F.col("_levels").isNotNull())


def update_inherited(
    state: GraphState,
    changed_nodes: DataFrame,
    changed_edges: DataFrame,
    edge_types: DataFrame,
    batch_id: str,
    default_weight: int = DEFAULT_WEIGHT,
) -> GraphState:
    """The state after a batch: nodes and edges with the columns of the full tables, each row its new state."""
    if has_batch(state.nodes, batch_id):
        return open_state(state.nodes.spark, state.nodes.path.rpartition("/")[0])
    cols = state.cols
    arcs = cut_lineage(_arc_rows(changed_edges, edge_types, default_weight))
    changed = cut_lineage(_node_rows(changed_nodes, cols))
    out = apply_batch(state.out, arcs, _replace_arcs, batch_id)
    into = apply_batch(state.into, arcs, _replace_arcs, batch_id)
    depth = state.nodes.read().select(F.size("sums")).first()
    depth = depth[0] if depth else MAX_DEPTH

    # Nodes with a changed arc: of a changed edge, or into a changed node; and new nodes, whose arcs may be older.
    entered = into.lookup(changed.select(F.col("identifier").alias("y"))).select("x")
    seeds = cut_lineage(arcs.select("x").union(entered).union(changed.select("identifier")).distinct())

    def passing(nodes: DataFrame) -> DataFrame:
        """Those that some arc enters."""
        return into.present(nodes.select(F.col("x").alias("y"))).select(F.col("y").alias("x"))

    hubs = cut_lineage(passing(seeds))
    asked: DataFrame | None = None  # nodes whose arcs into them have been read
    before: list[DataFrame] = []  # these arcs
    before_hubs: list[DataFrame] = []  # those of them that leave nodes which an arc enters
    gathered: DataFrame | None = None  # nodes whose arcs have been read
    steps: list[DataFrame] = []  # their arcs with gains and the stored sums behind them
    own: list[DataFrame] = []  # their own rows
    levels: list[DataFrame] = []  # sums that differ from the stored ones, by level
    for level in range(1, depth + 1):
        candidates = fresh = hubs
        # Only a live node passes on what it has.
        moved = levels[-1].where("live").select(F.col("x").alias("y")) if levels else None
        if moved is not None and not moved.isEmpty():
            unasked = moved if asked is None else cut_lineage(moved.join(asked, "y", "left_anti"))
            if not unasked.isEmpty():
                before.append(cut_lineage(into.lookup(unasked).select("x", "y")))
                before_hubs.append(cut_lineage(before[-1].join(passing(before[-1].select("x")), "x", "left_semi")))
                asked = unasked if asked is None else asked.union(unasked)
            ahead = reduce(DataFrame.unionByName, before_hubs).join(moved, "y", "left_semi")
            candidates = cut_lineage(hubs.union(ahead.select("x")).distinct())
            fresh = cut_lineage(candidates.join(gathered, "x", "left_anti"))
        if gathered is None or (candidates is not hubs and not fresh.isEmpty()):
            rows = cut_lineage(_read_nodes(state.nodes, changed, fresh.select(F.col("x").alias("identifier")), cols))
            leaving = cut_lineage(out.lookup(rows.select(F.col("identifier").alias("x"))))
            ends = leaving.select(F.col("y").alias("identifier")).distinct()
            ends = _read_nodes(state.nodes, changed, ends, cols).where("live").drop("changed")
            ends = ends.withColumnsRenamed({"identifier": "y", "sums": "stored"})
            found = leaving.join(ends, "y").select("x", "y", "stored", *[_gain(c).alias(f"{c}_gain") for c in cols])
            steps.append(cut_lineage(found))
            own.append(rows.withColumnRenamed("identifier", "x"))
            gathered = fresh if gathered is None else gathered.union(fresh)
        walked = reduce(DataFrame.unionByName, steps).join(candidates, "x", "left_semi")
        stored = F.col("stored")[level - 2] if level > 1 else _none(cols)
        if levels:
            new = levels[-1].select(F.col("x").alias("y"), F.col("sums").alias("_new"))
            walked = walked.join(new, "y", "left").withColumn("onward", F.coalesce("_new", stored))
        else:
            walked = walked.withColumn("onward", stored)
        computed = _best(walked, cols).withColumnRenamed("sums", "_sums")
        mine = reduce(DataFrame.unionByName, own).join(candidates, "x", "left_semi")
        mine = mine.join(computed, "x", "left").withColumn("_sums", F.coalesce("_sums", _none(cols)))
        differ = mine.where(~F.col("_sums").eqNullSafe(F.col("sums")[level - 1]))
        levels.append(cut_lineage(differ.select("x", "live", F.col("_sums").alias("sums"))))

    result = ["identifier", "live", *cols, F.col("kept").alias("sums")]
    hub_rows = reduce(DataFrame.unionByName, own).withColumnRenamed("x", "identifier")
    batch = _overlaid(hub_rows, levels, "identifier", depth, cols).where("moved OR changed").select(*result)

    # Nodes that no arc enters, all levels at once.
    reached = reduce(DataFrame.union, [seeds, *[b.select("x") for b in before]]).distinct()
    leaves = cut_lineage(reached.join(reduce(DataFrame.union, [hubs, *[b.select("x") for b in before_hubs]]), "x", "left_anti"))
    if not leaves.isEmpty():
        leaving = cut_lineage(out.lookup(leaves))
        ends = leaving.select(F.col("y").alias("identifier")).distinct()
        ends = _read_nodes(state.nodes, changed, ends, cols).where("live").withColumnRenamed("identifier", "y")
        ends = cut_lineage(_overlaid(ends, levels, "y", depth, cols).select("y", *cols, F.col("kept").alias("behind")))
        walked = _best_of_levels(leaving, ends, cols, depth).withColumnRenamed("x", "identifier")
        rows = _read_nodes(state.nodes, changed, leaves.select(F.col("x").alias("identifier")), cols)
        nothing = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda _: _none(cols))
        rows = rows.join(walked, "identifier", "left").withColumn("kept", F.coalesce("walked", nothing))
        batch = batch.unionByName(rows.where(F.col("changed") | ~F.col("kept").eqNullSafe(F.col("sums"))).select(*result))
    nodes = apply_batch(state.nodes, batch, lambda t, b: merge_upsert(t, b, ["identifier"]), batch_id)
    return GraphState(nodes, out, into)
