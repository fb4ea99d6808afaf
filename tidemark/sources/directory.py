"""Directory extracts: attribute values in long form, ranged slices, replication metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import decode

RANGE_SLICE = 1500

# Field names of the two replication metadata documents; fixed values.
ATTRIBUTE_FIELDS = (
    "pszAttributeName string, dwVersion int, ftimeLastOriginatingChange string, "
    "uuidLastOriginatingDsaInvocationID string, usnOriginatingChange bigint, usnLocalChange bigint, "
    "pszLastOriginatingDsaDN string"
)
VALUE_FIELDS = ATTRIBUTE_FIELDS + ", pszObjectDn string, cbData int, ftimeCreated string, ftimeDeleted string"


def decode_attributes(values: DataFrame, attribute_schema: DataFrame) -> DataFrame:
    """Decode raw attribute values into a struct of typed fields, by the syntax of each attribute.

    ``values`` has columns ``attribute`` and ``raw``; ``attribute_schema`` has ``attribute``, ``om_syntax`` and
    ``attribute_syntax``.  Names compare ignoring case, and of several rows of one name the greatest syntax counts; an attribute the
    schema lacks decodes as text.
    """
    syntax = (
        attribute_schema.groupBy(F.lower("attribute").alias("_name"))
        .agg(F.max(F.struct("om_syntax", "attribute_syntax")).alias("_s"))
        .select("_name", F.col("_s.om_syntax").alias("_om"), F.col("_s.attribute_syntax").alias("_oid"))
    )
    raw, om, oid = F.col("raw"), F.col("_om"), F.col("_oid")
    # oMSyntax numbers and attributeSyntax identifiers of the decoders.
    kind = (
        F.when(om == 1, "boolean")
        .when(om.isin(2, 10), "integer")
        .when((om == 65) & (oid == "2.5.5.16"), "long")
        .when(om.isin(23, 24), "time")
        .when((om == 4) & (oid == "2.5.5.10"), "bytes")
        .when(om == 66, "bytes")
        .when((om == 4) & (oid == "2.5.5.17"), "sid")
        .otherwise("text")
    )
    k = F.col("_kind")
    typed = F.struct(
        k.alias("kind"),
        F.when(k == "boolean", decode.boolean(raw)).alias("boolean"),
        F.when(k == "integer", decode.integer(raw)).alias("integer"),
        F.when(k == "long", decode.large_integer(raw)).alias("long"),
        F.when(k == "time", decode.generalized_time(raw)).alias("time"),
        F.when(k == "text", decode.text(raw)).when(k == "sid", decode.sid(raw)).alias("text"),
        F.when(k == "bytes", raw).alias("bytes"),
    )
    joined = values.withColumn("_name", F.lower("attribute")).join(syntax, "_name", "left")
    return joined.withColumn("_kind", kind).withColumn("value", typed).drop("raw", "_name", "_om", "_oid", "_kind")


def assemble_records(values: DataFrame, slice_size: int = RANGE_SLICE) -> DataFrame:
    """Records from long attribute rows ``(dn, attribute, ordinal, value)``: a map of attribute to value array.

    An attribute without values (ordinal null) maps to null.  Attributes with more values than one slice continue
    in further rows of the same ``dn`` with the next ``slice``, as directory servers return them, so no array and
    no group grows with the data.
    """
    size = F.lit(slice_size)
    part = F.coalesce(F.call_function("div", F.col("ordinal"), size), F.lit(0).cast("bigint")).cast("int")
    parts = (
        values.withColumn("slice", part)
        .repartition("dn", "slice")  # serves both aggregations
        .groupBy("dn", "slice", F.lower("attribute").alias("attribute"))
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "value")))
            ).alias("_pairs")
        )
    )
    ordered = F.when(F.size("_pairs") > 0, F.transform("_pairs", lambda p: p["value"]))
    return (
        parts.withColumn("_values", ordered)
        .groupBy("dn", "slice")
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "_values")))).alias("attributes")
        )
    )


def collect_ranges(slices: DataFrame) -> DataFrame:
    """All values of ranged attributes in order: ``(…, attribute, ordinal, value)``.

    ``slices`` has ``attribute`` like ``member;range=1500-2999`` or ``member;range=3000-*`` and ``values``.  The
    position follows from the range start, so slices need not meet: nothing is shuffled and nothing accumulates.
    """
    others = [c for c in slices.columns if c not in ("attribute", "values")]
    start = F.regexp_extract("attribute", r"(?i);range=(\d+)-", 1)
    offset = F.coalesce(start.try_cast("bigint"), F.lit(0).cast("bigint"))
    name = F.regexp_replace("attribute", r"(?i);range=\d+-(\d+|\*)$", "")
    return slices.select(
        *others, name.alias("attribute"), offset.alias("_offset"), F.posexplode("values").alias("_pos", "value")
    ).select(*others, "attribute", (F.col("_offset") + F.col("_pos")).alias("ordinal"), "value")


def under_base_dn(df: DataFrame, base_dn: str, dn_col: str = "dn", scope: str = "subtree") -> DataFrame:
    """Rows at or below a base name: ``base`` only it, ``onelevel`` its children, ``subtree`` all."""
    dn, base = F.lower(dn_col), base_dn.lower()
    if scope == "base":
        return df.where(dn == base)
    below = dn.endswith("," + base)
    if scope == "subtree":
        return df.where((dn == base) | below)
    if scope != "onelevel":
        raise ValueError(f"unknown scope {scope!r}")
    own_part = F.substring(dn, F.lit(1), F.length(dn) - (len(base) + 1))
    return df.where(below & ~own_part.rlike(r"(?<!\\),"))


def parse_repl_metadata(df: DataFrame, xml_col: str, values: bool = False) -> DataFrame:
    """Replication metadata documents as rows; ``values`` selects the per-value form with object and deletion data.

    Takes single documents, several in a row, or a blob document around them.  A malformed one fails the job.
    """
    row = VALUE_FIELDS if values else ATTRIBUTE_FIELDS
    tag = "DS_REPL_VALUE_META_DATA" if values else "DS_REPL_ATTR_META_DATA"
    typed = ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in row.split(", "))
    schema = f"struct<{tag}: array<struct<{typed}>>, {tag}_BLOB: struct<{tag}: array<struct<{typed}>>>>"
    body = F.regexp_replace(F.col(xml_col), r"<\?xml[^>]*\?>|\x00", "")
    parsed = F.from_xml(F.concat(F.lit("<docs>"), body, F.lit("</docs>")), schema, {"rowTag": "docs", "mode": "FAILFAST"})
    others = [c for c in df.columns if c != xml_col]
    entries = F.concat(
        F.coalesce(F.col(f"_doc.{tag}"), F.array()), F.coalesce(F.col(f"_doc.{tag}_BLOB.{tag}"), F.array())
    )
    rows = df.withColumn("_doc", parsed).select(*others, F.explode(entries).alias("_e"))
    columns = {
        "attribute": F.col("_e.pszAttributeName"),
        "version": F.col("_e.dwVersion"),
        "changed": decode.filetime(F.col("_e.ftimeLastOriginatingChange")),
        "invocation_id": F.col("_e.uuidLastOriginatingDsaInvocationID"),
        "usn_originating": F.col("_e.usnOriginatingChange"),
        "usn_local": F.col("_e.usnLocalChange"),
        "dsa_dn": F.col("_e.pszLastOriginatingDsaDN"),
    }
    if values:
        columns |= {
            "object_dn": F.col("_e.pszObjectDn"),
            "data_size": F.col("_e.cbData"),
            "created": decode.filetime(F.col("_e.ftimeCreated")),
            "deleted": decode.filetime(F.col("_e.ftimeDeleted")),
            "is_deleted": decode.is_deleted_filetime(F.col("_e.ftimeDeleted")),
        }
    return rows.select(*others, *[column.alias(name) for name, column in columns.items()])
