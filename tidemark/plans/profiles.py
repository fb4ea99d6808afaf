"""Schema inference over whole tables and open property bags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import length_bucket
from tidemark.operators import profile
from tidemark.operators.platform import into_platform
from tidemark.plans.registry import Tables, query
from tidemark.schemas import schema
from tidemark.session import cut_lineage

FLAG_NAMES = [f"has_{f}" for f in profile.FLAGS]


def _profile_sql(table: str, columns: dict[str, str], by: str = "'Default'", columns_out: str = "*") -> str:
    """One aggregate query per column; ``columns`` maps each to its kind."""
    parts = []
    for name, kind in columns.items():
        text, whole = kind == "string", kind in ("integer", "long")
        utf16 = rf"length({name}) + len(regexp_extract_all({name}, '[\x{{10000}}-\x{{10FFFF}}]'))"
        length = f"coalesce(max({utf16}), 0)" if text else "0"
        unicode = f"coalesce(bool_or(strlen({name}) <> length({name})), false)" if text else "false"
        flags = ", ".join(
            (f"bool_or({name} IS NOT NULL)" if f == kind else "false") + f" AS has_{f}" for f in profile.FLAGS
        )
        low, high = (f"CAST({m}({name}) AS BIGINT)" if whole else "CAST(0 AS BIGINT)" for m in ("min", "max"))
        parts.append(
            f"SELECT {by} AS entity_type, '{name}' AS property, count(*) AS observations, "
            f"count(*) - count({name}) AS nulls, CAST({length} AS INTEGER) AS max_length, {unicode} AS has_unicode, "
            f"{flags}, {low} AS min_integer, {high} AS max_integer FROM {table} GROUP BY 1"
        )
    return f"SELECT {columns_out} FROM (" + "\nUNION ALL ".join(parts) + ")"


CUSTOMER = {
    "c_custkey": "long",
    "c_name": "string",
    "c_nationkey": "integer",
    "c_acctbal": "double",
    "c_mktsegment": "string",
}


def _filled(profiles: DataFrame) -> DataFrame:
    """Properties without whole numbers show 0 as their bounds."""
    return profiles.fillna(0, ["min_integer", "max_integer"])


@query("profile_customer", _profile_sql("customer", CUSTOMER))
def profile_customer(t: Tables) -> DataFrame:
    return _filled(profile.profile_properties(t.customer))


DOCUMENTS = {"doc_id": "long", "text": "string", "source": "string", "n_chars": "long"}


@query("profile_documents", _profile_sql("documents", DOCUMENTS, by="lang"))
def profile_documents(t: Tables) -> DataFrame:
    return _filled(profile.profile_properties(t.documents, by="lang"))


LINEITEM = {
    "l_orderkey": "long",
    "l_linenumber": "integer",
    "l_partkey": "long",
    "l_suppkey": "long",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "datetime",
}


@query("profile_lineitem", _profile_sql("lineitem", LINEITEM))
def profile_lineitem(t: Tables) -> DataFrame:
    return _filled(profile.profile_properties(t.lineitem))


BAG_SQL = """
    SELECT event_type AS entity_type, 'k' AS property, count(*) AS observations, CAST(0 AS BIGINT) AS nulls,
           CAST(0 AS INTEGER) AS max_length, false AS has_unicode, false AS has_boolean, false AS has_integer,
           true AS has_long, false AS has_double, false AS has_datetime, false AS has_guid, false AS has_bytes,
           false AS has_string, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS min_integer,
           max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_integer
    FROM events GROUP BY event_type
"""


@query("profile_events_bag", BAG_SQL)
def profile_events_bag(t: Tables) -> DataFrame:
    return profile.profile_bag(t.events, "props", by="event_type")


@query(
    "column_definitions_open_bag",
    """
    WITH bag AS (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events),
    p AS (
        SELECT 'amount' AS property, 'FLOAT' AS kind, 0 AS nulls, count(*) AS n FROM bag
        UNION ALL SELECT 'costly', 'BIT', 0, count(*) FROM bag
        UNION ALL SELECT 'k', CASE WHEN min(k) < -2147483648 OR max(k) > 2147483647 THEN 'BIGINT' ELSE 'INT' END,
                         count(*) - count(k), count(*) FROM bag
        UNION ALL SELECT 'name', 'VARCHAR(' || list_min(list_filter([16, 32, 50, 100, 128, 256, 450, 512, 1024, 2048, 4000],
                                 lambda s: s >= floor(max(length(event_type)) * CAST(1.2 AS DOUBLE)))) || ')', 0, count(*)
        FROM bag WHERE event_type = 'click')
    SELECT 'Default' AS entity_type, property,
           '[' || property || '] ' || kind || CASE WHEN nulls > 0 THEN ' NULL' ELSE ' NOT NULL' END AS definition
    FROM p WHERE n > 0
    """,
)
def column_definitions_open_bag(t: Tables) -> DataFrame:
    """Bags of mixed content: ``k`` is null on errors, ``name`` is present on clicks only."""
    text = F.concat(
        F.lit('{"k":'),
        F.when(F.col("event_type") == "error", "null").otherwise(F.get_json_object("props", "$.k")),
        F.lit(',"amount":'),
        F.format_string("%.2f", "value"),
        F.lit(',"costly":'),
        (F.col("value") > 10).cast("string"),
        F.when(F.col("event_type") == "click", ',"name":"click"').otherwise(""),
        F.lit("}"),
    )
    columns = profile.infer_columns(profile.profile_bag(t.events.select(text.alias("bag")), "bag"))
    return columns.select("entity_type", "property", "definition")


DEFINITIONS = (
    "WITH p AS ("
    + _profile_sql("documents", {**DOCUMENTS, "lang": "string"})
    + " UNION ALL "
    + _profile_sql("lineitem", LINEITEM)
    + """),
    typed AS (
        SELECT property, nulls > 0 AS is_nullable, max_length, CAST(floor(max_length * CAST(1.2 AS DOUBLE)) AS INTEGER) AS padded,
               CASE WHEN has_datetime THEN 'DATETIME2' WHEN has_double THEN 'FLOAT'
                    WHEN has_integer OR has_long THEN
                         CASE WHEN min_integer < -2147483648 OR max_integer > 2147483647 THEN 'BIGINT' ELSE 'INT' END
                    WHEN has_unicode THEN 'NVARCHAR' ELSE 'VARCHAR' END AS sql_type
        FROM p),
    sized AS (
        SELECT *, CASE WHEN sql_type NOT IN ('VARCHAR', 'NVARCHAR') OR max_length = 0 THEN NULL ELSE
               list_min(list_filter([16, 32, 50, 100, 128, 256, 450, 512, 1024, 2048, 4000], lambda s: s >= padded)) END AS column_length
        FROM typed)
    SELECT property, sql_type, coalesce(column_length, -1) AS column_length, is_nullable,
           '[' || property || '] ' || sql_type
           || CASE WHEN sql_type IN ('VARCHAR', 'NVARCHAR') THEN '(' || coalesce(CAST(column_length AS VARCHAR), 'MAX') || ')'
                   WHEN sql_type = 'DATETIME2' THEN '(7)' ELSE '' END
           || CASE WHEN is_nullable THEN ' NULL' ELSE ' NOT NULL' END AS definition
    FROM sized
    """
)


@query("column_definitions", DEFINITIONS)
def column_definitions(t: Tables) -> DataFrame:
    profiles = profile.profile_properties(t.documents).unionByName(profile_lineitem(t))
    return profile.infer_columns(profiles).select(
        "property", "sql_type", "column_length", "is_nullable", "definition"
    ).fillna(-1, ["column_length"])


@query(
    "platform_columns",
    f"""
    SELECT 'Default' AS table_name, property AS column_name, sql_type AS data_type, column_length AS max_length, is_nullable,
           TIMESTAMP '2024-02-01' AS inserted, 'designer' AS inserted_by,
           CASE WHEN starts_with(property, 'l_') THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '2024-02-01' END AS updated,
           CAST(CASE WHEN starts_with(property, 'l_') THEN 2 ELSE 1 END AS BIGINT) AS row_version
    FROM ({DEFINITIONS})
    """,
)
def platform_columns(t: Tables) -> DataFrame:
    """Inferred columns enter the platform's column table; a second run corrects those of the line items."""
    inferred = column_definitions(t).select(
        F.lit("Default").alias("table_name"),
        F.col("property").alias("column_name"),
        F.col("sql_type").alias("data_type"),
        F.col("column_length").alias("max_length"),
        "is_nullable",
    )
    stored = cut_lineage(inferred)
    lines = F.startswith(F.col("column_name"), F.lit("l_"))
    first = stored.withColumn("data_type", F.when(lines, "SQL_VARIANT").otherwise(F.col("data_type")))
    keys, empty = ["table_name", "column_name"], t.spark.createDataFrame([], schema("column"))
    once = into_platform(empty, first, "column", keys, "2024-02-01", "designer")
    twice = into_platform(once, stored, "column", keys, "2024-02-02", "designer")
    return twice.select(*stored.columns, "inserted", "inserted_by", "updated", "row_version")


@query(
    "entity_types",
    "SELECT event_type AS entity_type, count(*) AS entities, CAST(1 AS BIGINT) AS properties FROM events GROUP BY 1",
)
def entity_types(t: Tables) -> DataFrame:
    return profile.entity_types(t.events, "event_type", profile_events_bag(t))


@query(
    "length_bucket",
    """
    SELECT doc_id, coalesce(CASE WHEN length(text) > 0 THEN
        list_min(list_filter([16, 32, 50, 100, 128, 256, 450, 512, 1024, 2048, 4000],
                             lambda s: s >= floor(length(text) * CAST(1.2 AS DOUBLE)))) END, -1) AS bucket
    FROM documents
    """,
)
def length_buckets(t: Tables) -> DataFrame:
    buckets = t.documents.select("doc_id", length_bucket(F.char_length("text")).alias("bucket"))
    return buckets.fillna(-1, ["bucket"])
