"""Sources, result pages and the mapping of source rows to target columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text
from tidemark.plans.registry import Tables, query
from tidemark.sources import mapping, pages, tables


@query(
    "read_table",
    "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25",
)
def read_table(t: Tables) -> DataFrame:
    return tables.read_table(
        t.spark,
        f"{t.folder}/lineitem.parquet",
        cols=["l_orderkey", "l_partkey", "l_shipdate"],
        where=("and", ("eq", "l_returnflag", "R"), ("ge", "l_quantity", 25)),
    )


@query("scan_entities", "SELECT o_orderkey AS O_ORDERKEY, o_orderstatus AS O_ORDERSTATUS FROM orders")
def scan_entities(t: Tables) -> DataFrame:
    return tables.scan_entities(t.orders, ["O_ORDERKEY", "O_ORDERSTATUS", "not_there"])


@query(
    "map_properties",
    """
    SELECT c_custkey AS id, c_name AS display_name, 'customer' AS kind,
           coalesce(nullif(c_mktsegment, 'MACHINERY'), '') || '/' || c_nationkey AS path, c_mktsegment
    FROM customer
    """,
)
def map_properties(t: Tables) -> DataFrame:
    customers = t.customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return mapping.map_properties(
        customers,
        {
            "id": "c_custkey",
            "display_name": "c_name",
            "kind": ("lit", "customer"),
            "path": ("template", "<%segment%>/<%c_nationkey%>"),
            "c_mktsegment": None,
        },
    )


@query(
    "align_to_target",
    """
    SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size, p_retailprice FROM part
    """,
)
def align_to_target(t: Tables) -> DataFrame:
    target = T.StructType.fromDDL("p_partkey int, p_name string, p_size string, p_retailprice double, absent int")
    return mapping.align_to_target(t.part, target, ["p_partkey"])


@query(
    "normalise_keys",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, CAST(2 AS INTEGER) AS size
    FROM events
    """,
)
def normalise_keys(t: Tables) -> DataFrame:
    """The bag carries ``Kind`` and ``KIND``; the later one wins."""
    number = F.get_json_object("props", "$.k")
    bag = F.create_map(
        F.lit("K"), number, F.lit("Kind"), F.col("user_id").cast("string"), F.lit("KIND"), F.col("event_type")
    )
    out = mapping.normalise_keys(t.events.select("event_id", bag.alias("bag")), "bag")
    return out.select(
        "event_id",
        F.col("bag.k").cast("bigint").alias("k"),
        F.col("bag.kind").alias("kind"),
        F.size("bag").alias("size"),
    )


@query(
    "typed_properties",
    """
    WITH typed AS (
        SELECT event_id, 'k' AS property, 'long' AS kind, NULL::VARCHAR AS string_value,
               CAST(json_extract(props, '$.k') AS BIGINT) AS long_value, NULL::VARCHAR AS decimal_text,
               NULL::DOUBLE AS double_value, NULL::BOOLEAN AS boolean_value FROM events
        UNION ALL SELECT event_id, 'type', 'string', event_type, NULL, NULL, NULL, NULL FROM events
        UNION ALL SELECT event_id, 'costly', 'boolean', NULL, NULL, NULL, NULL, value > 10 FROM events
        UNION ALL SELECT event_id, 'none', 'null', NULL, NULL, NULL, NULL, NULL FROM events
        UNION ALL SELECT event_id, 'ratio', 'decimal', NULL, NULL, '0.' || user_id || '1234567890123',
                         CAST('0.' || user_id || '1234567890123' AS DOUBLE), NULL FROM events
        UNION ALL SELECT event_id, 'ids', 'raw', '[' || event_id || ',' || user_id || ']', NULL, NULL, NULL, NULL FROM events)
    SELECT event_id, property, kind, string_value, decimal_text, coalesce(long_value, 0) AS long_value,
           coalesce(double_value, 0) AS double_value, coalesce(boolean_value, false) AS boolean_value,
           long_value IS NULL AS no_long, double_value IS NULL AS no_double, boolean_value IS NULL AS no_boolean
    FROM typed
    """,
)
def typed_properties(t: Tables) -> DataFrame:
    body = F.concat(
        F.lit('{"k":'),
        F.get_json_object("props", "$.k"),
        F.lit(',"type":"'),
        F.col("event_type"),
        F.lit('","costly":'),
        (F.col("value") > 10).cast("string"),
        F.concat(F.lit(',"none":null,"ratio":0.'), F.col("user_id").cast("string"), F.lit('1234567890123,"ids":[')),
        F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string")),
        F.lit("]}"),
    )
    typed = mapping.typed_properties(t.events.select("event_id", body.alias("body")), "body")
    absent = {f"no_{kind}": F.col(f"{kind}_value").isNull() for kind in ("long", "double", "boolean")}
    return typed.withColumns(absent).fillna(0, ["long_value", "double_value"]).fillna(False, ["boolean_value"])


@query(
    "rejected_pages",
    """
    SELECT o_orderkey AS page, 'page is not a JSON array' AS reject_reason FROM orders WHERE o_orderstatus = 'P'
    """,
)
def rejected_pages(t: Tables) -> DataFrame:
    """Pages of orders in process were cut off."""
    whole = F.to_json(F.array(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("kind"))))
    cut = F.substring(whole, F.lit(1), F.length(whole) - 3)
    value = F.when(F.col("o_orderstatus") == "P", cut).when(F.col("o_orderstatus") == "F", whole)
    landed = t.orders.select(F.col("o_orderkey").alias("page"), value.alias("value"))
    return pages.split_pages(landed)[1].drop("value")


def _mixed_pages(t: Tables) -> DataFrame:
    """Pages of two records by line item; those of returned lines hold a word for a number, some others are cut off."""
    quantity = F.when(F.col("l_returnflag") == "R", F.lit('"none"')).otherwise(F.col("l_quantity").cast("int").cast("string"))
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    value = F.concat(F.lit('[{"id":'), part, F.lit(',"n":1},{"id":'), supplier, F.lit(',"n":'), quantity, F.lit("}]"))
    cut = F.when(F.col("l_linestatus") == "O", F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    return t.lineitem.select(F.col("l_orderkey").alias("page"), cut.alias("value"))


@query(
    "quarantined_pages",
    """
    SELECT l_orderkey AS page, CASE WHEN l_linestatus = 'O' THEN 'page is not a JSON array'
                                    ELSE 'a record does not fit the schema' END AS reject_reason
    FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'R'
    """,
)
def quarantined_pages(t: Tables) -> DataFrame:
    return pages.split_pages(_mixed_pages(t), item_schema="id bigint, n int")[1].drop("value")


@query(
    "read_sound_pages",
    """
    SELECT l_orderkey AS page, l_partkey AS id, 1 AS n FROM lineitem WHERE l_linestatus <> 'O' AND l_returnflag <> 'R'
    UNION ALL
    SELECT l_orderkey, l_suppkey, CAST(l_quantity AS INTEGER) FROM lineitem WHERE l_linestatus <> 'O' AND l_returnflag <> 'R'
    """,
)
def read_sound_pages(t: Tables) -> DataFrame:
    """Records of the pages that the quarantine has let through."""
    sound, _ = pages.split_pages(_mixed_pages(t), item_schema="id bigint, n int")
    return pages.read_pages(sound, "value", "id bigint, n int")


def _pages(t: Tables) -> DataFrame:
    """One result page per line item, naming its part and its supplier; unshipped ones are empty."""
    records = F.to_json(
        F.array(
            F.struct(F.concat(F.lit("p"), "l_partkey").alias("id"), F.lit("part").alias("kind")),
            F.struct(F.concat(F.lit("s"), "l_suppkey").alias("id"), F.lit("supplier").alias("kind")),
        )
    )
    empty = F.col("l_linestatus") == "O"
    return t.lineitem.select(
        F.col("l_orderkey").alias("page"), F.when(empty, F.lit("[]")).otherwise(records).alias("value")
    )


@query(
    "read_pages",
    """
    SELECT l_orderkey AS page, 'p' || l_partkey AS id, 'part' AS kind FROM lineitem WHERE l_linestatus <> 'O'
    UNION ALL SELECT l_orderkey, 's' || l_suppkey, 'supplier' FROM lineitem WHERE l_linestatus <> 'O'
    """,
)
def read_pages(t: Tables) -> DataFrame:
    return pages.read_pages(_pages(t), "value", "id string, kind string")


@query(
    "union_endpoints",
    """
    SELECT l_orderkey AS page, 'p' || l_partkey AS id, 'part' AS kind, NULL::VARCHAR AS text, 'items' AS endpoint
    FROM lineitem WHERE l_linestatus <> 'O'
    UNION ALL SELECT l_orderkey, 's' || l_suppkey, 'supplier', NULL, 'items' FROM lineitem WHERE l_linestatus <> 'O'
    UNION ALL SELECT conv_id, role, NULL, text, 'turns' FROM conversations
    """,
)
def union_endpoints(t: Tables) -> DataFrame:
    turns = t.conversations.select(
        F.col("conv_id").alias("page"), F.array(F.struct(F.col("role").alias("id"), "text")).alias("value")
    )
    return pages.union_endpoints({"items": read_pages(t), "turns": pages.read_pages(turns)})


@query(
    "expand_relationships",
    """
    SELECT l_orderkey AS id, 'part:' || l_partkey AS member FROM lineitem
    UNION ALL SELECT l_orderkey, 'supplier:' || l_suppkey FROM lineitem
    """,
)
def expand_relationships(t: Tables) -> DataFrame:
    members = F.array(F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("supplier:"), "l_suppkey"))
    return pages.expand_relationships(t.lineitem.select(F.col("l_orderkey").alias("id"), members.alias("m")), "m")


@query(
    "expand_relationships_nested",
    """
    SELECT c_custkey AS id, c_name AS name, o_orderkey AS member
    FROM customer JOIN orders ON c_custkey = o_custkey
    """,
)
def expand_relationships_nested(t: Tables) -> DataFrame:
    entities = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    nested = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("member"))
    return pages.expand_relationships(entities, nested=nested, on=["id"])


@query(
    "extract_tags",
    r"""
    WITH found AS (
        SELECT page_id, unnest(regexp_extract_all(
            regexp_replace(html, '<!-- (\w+) (\w+) -->', '<!-- @\1: \2 --><!-- @Page \1-->', 'g'),
            '(?s)<!-- @(.*?)-->', 1)) AS content
        FROM pages)
    SELECT page_id, trim(split_part(content, ':', 1)) AS tag_name,
           trim(substring(content, position(':' IN content) + 1)) AS tag_value
    FROM found WHERE contains(content, ':')
    """,
)
def extract_tags(t: Tables) -> DataFrame:
    """The page comments rewritten as tags, each followed by one without a colon."""
    tagged = F.regexp_replace("html", r"<!-- (\w+) (\w+) -->", "<!-- @$1: $2 --><!-- @Page $1-->")
    return text.extract_tags(t.pages.select("page_id", tagged.alias("html")), "html")


@query(
    "hash_id",
    r"""
    WITH h AS (
        SELECT c_custkey, md5(encode(regexp_replace('customer.' || c_name, '(.)', '\1' || chr(0), 'g'))) AS h FROM customer)
    SELECT c_custkey, h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14]
           || '-' || h[17:20] || '-' || h[21:32] AS id
    FROM h
    """,
)
def hash_id(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.hash_id(F.lit("customer"), F.col("c_name")).alias("id"))
