"""Entity reads and joined identity views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import read, views
from tidemark.plans.registry import Tables, query

SENTINEL = "9999-12-31"


@query(
    "entity_read_basic",
    """
    SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal >= 1000
    ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 100
    """,
)
def entity_read_basic(t: Tables) -> DataFrame:
    return read.entity_read(
        t.customer,
        select=["c_custkey", "c_name", "c_acctbal"],
        where=("and", ("eq", "c_mktsegment", "HOUSEHOLD"), ("ge", "c_acctbal", 1000)),
        order=[("c_acctbal", "desc"), "c_custkey"],
        top=100,
    )


@query(
    "entity_read_text",
    """
    SELECT p_partkey, p_name FROM part
    WHERE (contains(p_name, 'widget') OR starts_with(p_name, 'blue')) AND NOT ends_with(p_name, 'ring')
    """,
)
def entity_read_text(t: Tables) -> DataFrame:
    return read.entity_read(
        t.part,
        select=["p_partkey", "p_name"],
        where=(
            "and",
            ("or", ("contains", "p_name", "widget"), ("startswith", "p_name", "blue")),
            ("not", ("endswith", "p_name", "ring")),
        ),
    )


@query(
    "entity_read_comparisons",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE (l_quantity > 10 AND l_quantity <= 40 AND l_returnflag <> 'N' AND l_discount < 0.05)
       OR l_shipdate >= TIMESTAMP '2001-01-01 00:00:00'
    """,
)
def entity_read_comparisons(t: Tables) -> DataFrame:
    return read.entity_read(
        t.lineitem,
        select=["l_orderkey", "l_linenumber", "l_partkey"],
        where=(
            "or",
            (
                "and",
                ("gt", "l_quantity", 10),
                ("le", "l_quantity", 40),
                ("ne", "l_returnflag", "N"),
                ("lt", "l_discount", 0.05),
            ),
            ("ge", "l_shipdate", "2001-01-01 00:00:00"),
        ),
    )


@query(
    "entity_read_nulls",
    """
    SELECT o_orderkey, o_orderstatus, priority
    FROM (SELECT *, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders)
    WHERE priority IS NULL OR (priority IS NOT NULL AND o_orderstatus = 'F')
    """,
)
def entity_read_nulls(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("priority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    return read.entity_read(
        orders,
        select=["o_orderkey", "o_orderstatus", "priority"],
        where=("or", ("eq", "priority", None), ("and", ("ne", "priority", None), ("eq", "o_orderstatus", "F"))),
    )


@query("entity_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def entity_distinct(t: Tables) -> DataFrame:
    return read.entity_read(t.orders, select=["o_orderpriority", "o_orderstatus"], distinct=True)


@query(
    "entity_page",
    """
    SELECT o_orderkey, o_orderdate FROM orders
    ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50
    """,
)
def entity_page(t: Tables) -> DataFrame:
    return read.entity_read(
        t.orders, select=["o_orderkey", "o_orderdate"], order=[("o_orderdate", "desc"), "o_orderkey"], top=25, skip=50
    )


@query(
    "entity_next_page",
    """
    SELECT count(*) AS rows, CASE WHEN count(*) = 25 THEN CAST(75 AS BIGINT) END AS next_skip
    FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50)
    """,
)
def entity_next_page(t: Tables) -> DataFrame:
    return read.next_page(entity_page(t), top=25, skip=50)


@query(
    "entity_page_after",
    """
    SELECT o_orderdate, o_orderkey, o_totalprice FROM orders
    WHERE o_orderdate < TIMESTAMP '2000-03-01' OR (o_orderdate = TIMESTAMP '2000-03-01' AND o_orderkey > 5000)
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 200
    """,
)
def entity_page_after(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderdate", "o_orderkey", "o_totalprice")
    return read.page_after(orders, [("o_orderdate", "desc"), "o_orderkey"], ["2000-03-01", 5000], top=200)


@query(
    "entity_count",
    """
    SELECT 'live' AS kind, count(*) AS count FROM events WHERE event_type <> 'error'
    UNION ALL SELECT 'all', count(*) FROM events
    UNION ALL SELECT 'filtered', count(*) FROM events WHERE value > 10
    """,
)
def entity_count(t: Tables) -> DataFrame:
    events = t.events.withColumn("deleted", F.when(F.col("event_type") == "error", F.col("ts")))
    counts = {
        "live": read.entity_count(events, deleted_col="deleted"),
        "all": read.entity_count(events, deleted_col="deleted", include_deleted=True),
        "filtered": read.entity_count(events, where=("gt", "value", 10)),
    }
    rows = [df.withColumn("kind", F.lit(kind)) for kind, df in counts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "search_any",
    """
    SELECT p_partkey, p_name, p_type, p_brand FROM part
    WHERE contains(p_name, 'an') OR contains(p_type, 'an') OR contains(p_brand, 'an')
    """,
)
def search_any(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", "p_name", "p_type", "p_brand")
    return read.search_any(parts, ["p_name", "p_type", "p_brand"], "an")


def _stamped_orders(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    deleted = F.when(status == "P", F.lit(SENTINEL).cast("timestamp_ntz")).when(status == "O", F.col("o_orderdate"))
    return t.orders.select("o_orderkey", "o_orderstatus", deleted.alias("deleted"))


@query(
    "live_rows",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
)
def live_rows(t: Tables) -> DataFrame:
    return read.live_rows(_stamped_orders(t), "deleted").drop("deleted")


@query(
    "live_rows_sentinel",
    """
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE coalesce(CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '9999-12-31' WHEN o_orderstatus = 'O' THEN o_orderdate END,
                   TIMESTAMP '9999-12-31') = TIMESTAMP '9999-12-31'
    """,
)
def live_rows_sentinel(t: Tables) -> DataFrame:
    return read.live_rows(_stamped_orders(t), "deleted", sentinel=SENTINEL).drop("deleted")


@query("minimal_view", "SELECT s_suppkey AS id, s_name AS display_name FROM supplier")
def minimal_view(t: Tables) -> DataFrame:
    return read.minimal_view(t.supplier.withColumnRenamed("s_name", "name"), "s_suppkey")


@query("optional_filters", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey = 3")
def optional_filters(t: Tables) -> DataFrame:
    suppliers = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    return read.optional_filters(suppliers, {"s_nationkey": 3, "s_name": None})


@query("find_by_id", "SELECT * FROM customer WHERE c_custkey = 42")
def find_by_id(t: Tables) -> DataFrame:
    return read.find_by_id(t.customer, "c_custkey", 42)


@query(
    "identity_view",
    """
    SELECT i.c_custkey AS id, i.c_name AS display_name, coalesce(nullif(i.c_custkey // 10, i.c_custkey), -1) AS manager_id,
           m.c_name AS manager_display_name, i.c_nationkey AS unit_id, n.n_name AS unit_display_name
    FROM customer i
    LEFT JOIN customer m ON nullif(i.c_custkey // 10, i.c_custkey) = m.c_custkey
    LEFT JOIN nation n ON i.c_nationkey = n.n_nationkey
    WHERE i.c_acctbal >= 0
    """,
)
def identity_view(t: Tables) -> DataFrame:
    manager = F.call_function("div", F.col("c_custkey"), F.lit(10).cast("bigint"))
    identities = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("display_name"),
        F.nullif(manager, "c_custkey").alias("manager_id"),
        F.col("c_nationkey").alias("unit_id"),
        F.when(F.col("c_acctbal") < 0, F.lit(SENTINEL)).cast("timestamp_ntz").alias("deleted"),
    )
    units = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("display_name"))
    return views.identity_view(identities, units).fillna(-1, ["manager_id"])


@query(
    "identity_page",
    """
    SELECT c_custkey AS id, c_name AS display_name FROM customer WHERE c_acctbal >= 0
    ORDER BY c_name, c_custkey LIMIT 100
    """,
)
def identity_page(t: Tables) -> DataFrame:
    """The default page of identities: by display name, the key breaking ties."""
    live = t.customer.where("c_acctbal >= 0").withColumnsRenamed({"c_custkey": "id", "c_name": "display_name"})
    return read.entity_read(live, ["id", "display_name"], order=["display_name", "id"], top=100)


@query(
    "newest_first_page",
    "SELECT event_id, ts FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 100",
)
def newest_first_page(t: Tables) -> DataFrame:
    """The default page of approval requests and the like: newest first."""
    live = t.events.where("event_type <> 'error'")
    return read.entity_read(live, ["event_id", "ts"], order=[("ts", "desc"), "event_id"], top=100)


@query(
    "approval_view",
    """
    SELECT o_orderkey AS id, r.o_orderstatus AS state_id, c_name AS approver_display_name,
           r.o_orderpriority AS approver, s.name AS state_name,
           coalesce(c_name, r.o_orderpriority, '') || ' - ' || s.name AS label
    FROM orders r
    LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey
    JOIN (SELECT DISTINCT o_orderstatus, 'State ' || o_orderstatus AS name FROM orders) s
      ON r.o_orderstatus = s.o_orderstatus
    WHERE r.o_orderpriority <> '5-LOW'
    """,
)
def approval_view(t: Tables) -> DataFrame:
    approvers = t.customer.where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("approver_display_name")
    )
    requests = t.orders.join(approvers, "o_custkey", "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("state_id"),
        "approver_display_name",
        F.col("o_orderpriority").alias("approver"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("deleted"),
    )
    states = t.orders.select(
        F.col("o_orderstatus").alias("state_id"), F.concat(F.lit("State "), "o_orderstatus").alias("name")
    ).distinct()
    return views.approval_view(requests, states)


@query(
    "entity_skip",
    """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS FIRST OFFSET 500
    """,
)
def entity_skip(t: Tables) -> DataFrame:
    """Everything behind the first 500 orders by date."""
    order = [("o_orderdate", "desc"), "o_orderkey"]
    return read.entity_read(t.orders, ["o_orderkey", "o_orderdate", "o_totalprice"], order=order, skip=500)
