"""Row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans.registry import Tables, query


@query(
    "validate_fields",
    r"""
    WITH c AS (
        SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment || '@example.' ||
               CASE WHEN c_acctbal > 5000 THEN 'com' ELSE 'c' END AS mail FROM customer)
    SELECT 'id' AS column, 'digits' AS rule, count(*) AS rows, count(*) FILTER (WHERE NOT regexp_matches(id, '^[0-9]+$')) AS violations FROM c
    UNION ALL SELECT 'name', 'guid', count(*), count(*) FROM c
    UNION ALL SELECT 'mail', 'email', count(*),
        count(*) FILTER (WHERE NOT regexp_matches(mail, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')) FROM c
    """,
)
def validate_fields(t: Tables) -> DataFrame:
    ending = F.when(F.col("c_acctbal") > 5000, "com").otherwise("c")
    customers = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat("c_mktsegment", F.lit("@example."), ending).alias("mail"),
    )
    return quality.validate_fields(customers, {"id": "digits", "name": "guid", "mail": "email"})


@query(
    "check_schema",
    """
    SELECT 'text' AS column, 'required' AS rule, count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS violations FROM documents
    UNION ALL SELECT 'lang', 'required', count(*), count(*) FILTER (WHERE lang = 'fr') FROM documents
    UNION ALL SELECT 'text', 'max_length 1000', count(*), count(*) FILTER (WHERE length(text) > 1000) FROM documents
    """,
)
def check_schema(t: Tables) -> DataFrame:
    documents = t.documents.withColumn("lang", F.nullif("lang", F.lit("fr")))
    return quality.check_schema(documents, required=["text", "lang"], max_length={"text": 1000})


@query(
    "check_unique",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, count(*) AS occurrences
    FROM lineitem GROUP BY ALL HAVING count(*) > 1
    UNION ALL
    SELECT l_orderkey, -1, -1, -1, NULL, count(*) FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
    """,
)
def check_unique(t: Tables) -> DataFrame:
    five = quality.check_unique(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"])
    one = quality.check_unique(t.lineitem, ["l_orderkey"])
    return five.unionByName(one, allowMissingColumns=True).fillna(-1)


@query(
    "check_references",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY')
    """,
)
def check_references(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return quality.check_references(lines, t.part.where("p_type <> 'ECONOMY'"), {"l_partkey": "p_partkey"})
