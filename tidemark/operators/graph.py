"""Risk factors inherited through a typed edge graph.

Walking an edge from node x (its ``node_to``) to node y (its ``node_from``) adds ``factor(y) * weight div 100``, and
a walk has at most ten steps.  Sums are capped at 255.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.read import live_rows
from tidemark.session import cut_lineage

MAX_FACTOR = 255
MAX_DEPTH = 10
DEFAULT_WEIGHT = 75
STORED_ROUNDS = 3  # a lost executor repeats at most so many rounds


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _capped(total: Column) -> Column:
    return F.least(total, _long(MAX_FACTOR))


def _arcs(
    nodes: DataFrame, edges: DataFrame, edge_types: DataFrame, cols: Sequence[str], default_weight: int
) -> DataFrame:
    """Live edges into live nodes with what a step along them adds to each factor: ``x, y`` and one column per factor.

    Every round reads them, so they are written once.
    """
    weights = edge_types.select("edge_type_id", F.col("factor").alias("_weight"))
    factors = live_rows(nodes, "deleted").select(
        F.col("identifier").alias("y"), *[F.col(c).cast("bigint").alias(f"_{c}") for c in cols]
    )
    weight = F.coalesce(F.col("_weight"), F.lit(default_weight)).cast("bigint")
    gains = [
        F.coalesce(F.call_function("div", F.col(f"_{c}") * weight, _long(100)), _long(0)).alias(c) for c in cols
    ]
    arcs = (
        live_rows(edges, "deleted")
        .select(F.col("node_to").alias("x"), F.col("node_from").alias("y"), "edge_type_id")
        .join(weights, "edge_type_id", "left")
        .join(factors, "y")
        .select("x", "y", *gains)
    )
    return cut_lineage(arcs)


def _step(arcs: DataFrame, onward: DataFrame | None, cols: Sequence[str]) -> DataFrame:
    """Best sums of walks that start with one of the arcs and go on with the best known walk from its end."""
    if onward is None:
        return arcs.groupBy("x").agg(*[_capped(F.max(c)).alias(c) for c in cols])
    known = onward.select(F.col("x").alias("y"), *[F.col(c).alias(f"_{c}") for c in cols])
    totals = [_capped(F.max(F.col(c) + F.coalesce(F.col(f"_{c}"), _long(0)))).alias(c) for c in cols]
    return arcs.join(known, "y", "left").groupBy("x").agg(*totals)


def _best_walks(arcs: DataFrame, cols: Sequence[str], depth: int, early_stop: bool) -> DataFrame:
    """Highest sum any walk of up to ``depth`` steps from x collects, per factor.

    What an arc adds does not depend on how the walk got there, and no gain is negative.  So the best walk of k steps
    from x is the best arc out of x plus the best walk of k-1 steps from its end: the state is one row per node,
    never one per path or per pair of nodes, and cycles need no care.

    Only nodes that some arc leads into are ever walked through.  All rounds but the last therefore use just the arcs
    between such nodes; the many nodes nobody inherits from take part once, in the last round.
    """
    best = None
    if depth > 1:
        inner = cut_lineage(arcs.join(arcs.select(F.col("y").alias("x")).distinct(), "x", "left_semi"))
        stored = None
        for k in range(1, depth):
            best = _step(inner, best, cols)
            if early_stop or k % STORED_ROUNDS == 0:
                best = cut_lineage(best)
                # Sums only grow, so they are final when no row differs from the stored round before.
                if stored is not None and best.join(stored, ["x", *cols], "left_anti").isEmpty():
                    break
                stored = best
    return _step(arcs, best, cols)


def _with_inherited(
    nodes: DataFrame,
    edges: DataFrame,
    edge_types: DataFrame,
    cols: Sequence[str],
    depth: int,
    default_weight: int,
    early_stop: bool,
) -> DataFrame:
    """Nodes with ``<col>_inherited`` for each factor; all factors share the rounds."""
    best = _best_walks(_arcs(nodes, edges, edge_types, cols, default_weight), cols, depth, early_stop)
    walked = best.select(F.col("x").alias("identifier"), *[F.col(c).alias(f"_{c}") for c in cols])
    inherited = {
        f"{c}_inherited": F.when(
            F.col("deleted").isNull(),
            _capped(F.coalesce(F.col(c).cast("bigint"), _long(0)) + F.coalesce(F.col(f"_{c}"), _long(0))),
        ).otherwise(_long(0))
        for c in cols
    }
    return nodes.join(walked, "identifier", "left").withColumns(inherited).drop(*[f"_{c}" for c in cols])


def inherited_factor(
    nodes: DataFrame,
    edges: DataFrame,
    edge_types: DataFrame,
    col: str = "a_factor",
    depth: int = MAX_DEPTH,
    default_weight: int = DEFAULT_WEIGHT,
    early_stop: bool = False,
) -> DataFrame:
    """Highest factor sum any walk from each node collects: ``(identifier, inherited)``, 0 for deleted nodes.

    Every third round is stored, and the rounds end once nothing has changed since the one stored before;
    ``early_stop`` does so after every round, which pays on large graphs that are much shallower than ``depth``.
    """
    out = _with_inherited(nodes, edges, edge_types, [col], depth, default_weight, early_stop)
    return out.select("identifier", F.col(f"{col}_inherited").alias("inherited"))


def with_inherited(
    nodes: DataFrame,
    edges: DataFrame,
    edge_types: DataFrame,
    depth: int = MAX_DEPTH,
    default_weight: int = DEFAULT_WEIGHT,
    early_stop: bool = False,
) -> DataFrame:
    """Nodes with both inherited factors, ``a_factor_inherited`` and ``c_factor_inherited``."""
    return _with_inherited(nodes, edges, edge_types, ["a_factor", "c_factor"], depth, default_weight, early_stop)


def _walks(start: DataFrame, arcs: DataFrame, depth: int) -> DataFrame:
    """Levels of the walk from every start node: ``(root, node, gain, depth)``, one row per pair and level.

    Paths that meet in a node merge there.  Every level is written once and read by the next one and by the result;
    the walk ends with the first empty level.
    """
    level = start.select("root", F.col("root").alias("node"), _long(0).alias("gain"))
    rows = level.withColumn("depth", F.lit(0))
    steps = arcs.select(F.col("x").alias("node"), "y", F.col("gain").alias("_gain"))
    for step in range(1, depth + 1):
        level = cut_lineage(
            level.join(steps, "node")
            .groupBy("root", F.col("y").alias("node"))
            .agg(_capped(F.max(F.col("gain") + F.col("_gain"))).alias("gain"))
        )
        if level.isEmpty():
            break
        rows = rows.unionByName(level.withColumn("depth", F.lit(step)))
    return rows


def reachable(
    nodes: DataFrame,
    edges: DataFrame,
    edge_types: DataFrame,
    roots: DataFrame,
    col: str = "a_factor",
    depth: int = MAX_DEPTH,
    default_weight: int = DEFAULT_WEIGHT,
) -> DataFrame:
    """Nodes that each given root reaches: ``(root, node, factor, accumulated, depth)``, best sum and fewest steps.

    ``roots`` (column ``identifier``) names the starting nodes.  Each level is walked from the nodes that the one before
    it has reached, so nodes that no root reaches take no part.
    """
    live = cut_lineage(
        live_rows(nodes, "deleted").select(
            F.col("identifier").alias("root"), F.coalesce(F.col(col).cast("bigint"), _long(0)).alias("own")
        )
    )
    arcs = _arcs(nodes, edges, edge_types, [col], default_weight).withColumnRenamed(col, "gain")
    start = live.join(roots.select(F.col("identifier").alias("root")).distinct(), "root", "left_semi")
    best = [F.max("gain").alias("gain"), F.min("depth").alias("depth")]
    pairs = _walks(start, arcs, depth).groupBy("root", "node").agg(*best)
    factors = live.select(F.col("root").alias("node"), F.col("own").alias("factor"))
    return (
        pairs.join(live, "root")
        .join(factors, "node")
        .select("root", "node", "factor", _capped(F.col("own") + F.col("gain")).alias("accumulated"), "depth")
    )
