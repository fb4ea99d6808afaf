"""Risk factors over the graph of regions, nations, customers, suppliers and orders.

An order inherits from its customer and suppliers, those from their nation, a nation from its region and the next
nation, so the nations form a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graph, graph_state, views
from tidemark.plans.registry import Tables, query
from tidemark.session import work_path

GRAPH_SQL = """
    nodes AS (
        SELECT 'R' || r_regionkey AS identifier, r_name AS display_name, 'region' AS type,
               CAST(r_regionkey * 9 + 3 AS BIGINT) AS a_factor, CAST(40 AS BIGINT) AS c_factor, NULL::TIMESTAMP AS deleted FROM region
        UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation', n_nationkey * 3 % 50, 7, NULL FROM nation
        UNION ALL SELECT 'C' || c_custkey, c_name, 'customer', length(c_mktsegment), c_custkey % 256,
               CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-01' END FROM customer
        UNION ALL SELECT 'S' || s_suppkey, s_name, 'supplier', s_suppkey % 256, 12,
               CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2024-01-01' END FROM supplier
        UNION ALL SELECT 'O' || o_orderkey, NULL, 'order', o_custkey % 100, 1,
               CASE WHEN o_orderstatus = 'P' THEN o_orderdate END FROM orders),
    types AS (
        SELECT 'T' || r_regionkey AS edge_type_id, 'type ' || r_name AS name, CAST(r_regionkey * 25 AS BIGINT) AS factor FROM region),
    edges AS (
        SELECT 'N' || n_nationkey AS node_to, 'R' || n_regionkey AS node_from, 'T4' AS edge_type_id, NULL::TIMESTAMP AS deleted FROM nation
        UNION ALL SELECT 'N' || n_nationkey, 'N' || ((n_nationkey + 1) % 25), NULL, NULL FROM nation
        UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'T3', NULL FROM customer
        UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'T2', NULL FROM supplier
        UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 'T1', NULL FROM orders
        UNION ALL SELECT 'O' || l_orderkey, 'S' || l_suppkey, 'T4', CASE WHEN l_returnflag = 'R' THEN l_shipdate END FROM lineitem)
"""


def _walk_sql(col: str) -> str:
    return f"""
    WITH RECURSIVE {GRAPH_SQL},
    live AS (SELECT identifier AS id, {col} AS f FROM nodes WHERE deleted IS NULL),
    arcs AS (
        SELECT node_to AS x, id AS y, (f * coalesce(factor, 75)) // 100 AS gain
        FROM edges e JOIN live ON node_from = id LEFT JOIN types USING (edge_type_id) WHERE e.deleted IS NULL),
    walk(root, node, acc, depth) AS (
        SELECT id, id, CAST(f AS BIGINT), 0 FROM live
        UNION ALL
        SELECT root, y, least(CAST(255 AS BIGINT), acc + gain), depth + 1 FROM walk JOIN arcs ON node = x WHERE depth < 10)
    """


def _key(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


def _nodes(t: Tables) -> DataFrame:
    def part(df: DataFrame, key: Column, name: Column, kind: str, a: Column, c: Column, deleted: Column) -> DataFrame:
        return df.select(
            key.alias("identifier"),
            name.alias("display_name"),
            F.lit(kind).alias("type"),
            a.cast("bigint").alias("a_factor"),
            c.cast("bigint").alias("c_factor"),
            deleted.cast("timestamp_ntz").alias("deleted"),
        )

    none = F.lit(None)
    overdrawn = F.lit("2024-01-01")
    parts = [
        part(t.region, _key("R", "r_regionkey"), F.col("r_name"), "region", F.col("r_regionkey") * 9 + 3, F.lit(40), none),
        part(t.nation, _key("N", "n_nationkey"), F.col("n_name"), "nation", F.col("n_nationkey") * 3 % 50, F.lit(7), none),
        part(
            t.customer, _key("C", "c_custkey"), F.col("c_name"), "customer", F.length("c_mktsegment"),
            F.col("c_custkey") % 256, F.when(F.col("c_acctbal") < 0, overdrawn),
        ),
        part(
            t.supplier, _key("S", "s_suppkey"), F.col("s_name"), "supplier", F.col("s_suppkey") % 256, F.lit(12),
            F.when(F.col("s_acctbal") < 0, overdrawn),
        ),
        part(
            t.orders, _key("O", "o_orderkey"), none.cast("string"), "order", F.col("o_custkey") % 100, F.lit(1),
            F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def _types(t: Tables) -> DataFrame:
    return t.region.select(
        _key("T", "r_regionkey").alias("edge_type_id"),
        F.concat(F.lit("type "), "r_name").alias("name"),
        (F.col("r_regionkey") * 25).cast("bigint").alias("factor"),
    )


def _edges(t: Tables) -> DataFrame:
    def part(df: DataFrame, to: Column, origin: Column, edge_type: str | None, deleted: Column) -> DataFrame:
        return df.select(
            to.alias("node_to"),
            origin.alias("node_from"),
            F.lit(edge_type).cast("string").alias("edge_type_id"),
            deleted.cast("timestamp_ntz").alias("deleted"),
        )

    none = F.lit(None)
    nation = _key("N", "n_nationkey")
    parts = [
        part(t.nation, nation, _key("R", "n_regionkey"), "T4", none),
        part(t.nation, nation, _key("N", (F.col("n_nationkey") + 1) % 25), None, none),
        part(t.customer, _key("C", "c_custkey"), _key("N", "c_nationkey"), "T3", none),
        part(t.supplier, _key("S", "s_suppkey"), _key("N", "s_nationkey"), "T2", none),
        part(t.orders, _key("O", "o_orderkey"), _key("C", "o_custkey"), "T1", none),
        part(
            t.lineitem, _key("O", "l_orderkey"), _key("S", "l_suppkey"), "T4",
            F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "edge_view",
    f"""
    WITH {GRAPH_SQL}
    SELECT e.node_to, e.node_from, e.edge_type_id, ty.name AS edge_type_name, coalesce(ty.factor, -1) AS factor,
           a.display_name AS node_to_display_name, a.type AS node_to_type, a.c_factor AS node_to_c_factor,
           a.a_factor AS node_to_a_factor, b.display_name AS node_from_display_name, b.type AS node_from_type,
           b.c_factor AS node_from_c_factor, b.a_factor AS node_from_a_factor
    FROM edges e LEFT JOIN types ty USING (edge_type_id)
    LEFT JOIN nodes a ON e.node_to = a.identifier LEFT JOIN nodes b ON e.node_from = b.identifier
    WHERE e.deleted IS NULL
    """,
)
def edge_view(t: Tables) -> DataFrame:
    return views.edge_view(_edges(t), _types(t), _nodes(t)).fillna(-1, ["factor"])


@query(
    "inherited_factor",
    _walk_sql("a_factor")
    + """
    SELECT identifier, coalesce(m, 0) AS inherited
    FROM nodes LEFT JOIN (SELECT root, max(acc) AS m FROM walk GROUP BY root) ON identifier = root
    """,
)
def inherited_factor(t: Tables) -> DataFrame:
    return graph.inherited_factor(_nodes(t), _edges(t), _types(t))


@query(
    "inherited_c_factor",
    _walk_sql("c_factor")
    + """
    SELECT identifier, coalesce(m, 0) AS inherited
    FROM nodes LEFT JOIN (SELECT root, max(acc) AS m FROM walk GROUP BY root) ON identifier = root
    """,
)
def inherited_c_factor(t: Tables) -> DataFrame:
    return graph.inherited_factor(_nodes(t), _edges(t), _types(t), col="c_factor", early_stop=True)


@query(
    "reachable",
    _walk_sql("a_factor")
    + """
    SELECT root, node, f AS factor, max(acc) AS accumulated, min(depth) AS depth
    FROM walk JOIN live ON node = id
    WHERE root IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY root, node, f
    """,
)
def reachable(t: Tables) -> DataFrame:
    """What the customers with an order in process reach."""
    asked = t.orders.where(F.col("o_orderstatus") == "P").select(_key("C", "o_custkey").alias("identifier"))
    return graph.reachable(_nodes(t), _edges(t), _types(t), asked)


@query(
    "with_inherited",
    _walk_sql("a_factor")
    + """,
    live_c AS (SELECT identifier AS id, c_factor AS f FROM nodes WHERE deleted IS NULL),
    arcs_c AS (
        SELECT node_to AS x, id AS y, (f * coalesce(factor, 75)) // 100 AS gain
        FROM edges e JOIN live_c ON node_from = id LEFT JOIN types USING (edge_type_id) WHERE e.deleted IS NULL),
    walk_c(root, node, acc, depth) AS (
        SELECT id, id, CAST(f AS BIGINT), 0 FROM live_c
        UNION ALL
        SELECT root, y, least(CAST(255 AS BIGINT), acc + gain), depth + 1 FROM walk_c JOIN arcs_c ON node = x WHERE depth < 10)
    SELECT n.*, coalesce(a.m, 0) AS a_factor_inherited, coalesce(c.m, 0) AS c_factor_inherited
    FROM nodes n LEFT JOIN (SELECT root, max(acc) AS m FROM walk GROUP BY root) a ON identifier = a.root
    LEFT JOIN (SELECT root, max(acc) AS m FROM walk_c GROUP BY root) c ON identifier = c.root
    """,
)
def with_inherited(t: Tables) -> DataFrame:
    return graph.with_inherited(_nodes(t), _edges(t), _types(t))


def _after_sql(col: str) -> str:
    """The walk over the graph in which a batch has replaced nodes and edges."""
    before = GRAPH_SQL.replace("nodes AS (", "nodes0 AS (", 1).replace("edges AS (", "edges0 AS (", 1)
    return _walk_sql(col).replace(
        GRAPH_SQL,
        f"""{before},
    nodes AS (
        SELECT identifier, display_name, type, CASE WHEN s_suppkey IS NULL THEN a_factor ELSE 200 END AS a_factor, c_factor,
               CASE WHEN c_custkey IS NULL THEN deleted ELSE TIMESTAMP '2024-02-02' END AS deleted
        FROM nodes0 LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000) ON identifier = 'S' || s_suppkey
        LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900) ON identifier = 'C' || c_custkey),
    changed AS (
        SELECT 'O' || l_orderkey AS node_to, 'S' || l_suppkey AS node_from, 'T4' AS edge_type_id, false AS live
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 480000 GROUP BY ALL
        UNION ALL SELECT 'S' || s_suppkey, 'R' || r_regionkey, 'T3', true
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 9000),
    edges AS (
        SELECT node_to, node_from, edge_type_id, NULL::TIMESTAMP AS deleted FROM edges0 e WHERE deleted IS NULL
        AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.node_to = e.node_to AND c.node_from = e.node_from
                        AND c.edge_type_id = e.edge_type_id)
        GROUP BY node_to, node_from, edge_type_id
        UNION ALL SELECT node_to, node_from, edge_type_id, NULL FROM changed WHERE live)
    """,
    )


@query(
    "update_inherited",
    _after_sql("a_factor")
    + """
    SELECT identifier, coalesce(m, 0) AS inherited
    FROM nodes LEFT JOIN (SELECT root, max(acc) AS m FROM walk GROUP BY root) ON identifier = root
    """,
)
def update_inherited(t: Tables) -> DataFrame:
    """Rich suppliers get a factor of 200 and an edge to their region, the richest customers leave, orders of great
    value lose their suppliers: only what lies before these changes is computed anew."""
    nodes, edges, types = _nodes(t), _edges(t), _types(t)
    state = graph_state.create_state(nodes, edges, types, work_path(t.spark, "graph"), parts=16)
    rich = t.supplier.where(F.col("s_acctbal") > 9000)
    richest = t.customer.where(F.col("c_acctbal") > 9900).select(_key("C", "c_custkey").alias("identifier"))
    suppliers = nodes.join(rich.select(_key("S", "s_suppkey").alias("identifier")), "identifier", "left_semi")
    gone = nodes.join(richest, "identifier", "left_semi").withColumn("deleted", F.lit("2024-02-02").cast("timestamp_ntz"))
    changed_nodes = suppliers.withColumn("a_factor", F.lit(200).cast("bigint")).unionByName(gone)
    dear = t.orders.where(F.col("o_totalprice") > 480000).select(F.col("o_orderkey").alias("l_orderkey"))
    lines = t.lineitem.join(dear, "l_orderkey").select(
        _key("O", "l_orderkey").alias("node_to"), _key("S", "l_suppkey").alias("node_from"), F.lit("T4").alias("edge_type_id"),
        F.lit("2024-02-02").cast("timestamp_ntz").alias("deleted"),
    )
    regions = rich.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        _key("S", "s_suppkey").alias("node_to"), _key("R", "n_regionkey").alias("node_from"), F.lit("T3").alias("edge_type_id"),
        F.lit(None).cast("timestamp_ntz").alias("deleted"),
    )
    after = graph_state.update_inherited(state, changed_nodes, lines.unionByName(regions), types, "rich suppliers")
    return graph_state.inherited(after, "a_factor")
