"""Changes to write to a directory, computed from source and current attribute values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import DELETED
from tidemark.session import cut_lineage


SALTS = 8  # parts in which the members of one object meet its flags


def plan_directory_changes(
    source: DataFrame,
    current: DataFrame,
    multi_valued: Sequence[str] = (),
    key: str = "dn",
    state_col: str = "_state",
) -> DataFrame:
    """Change rows ``(key, op, attribute, value)`` that bring the directory to the source state.

    Both sides are long: one row per key, attribute and value.  They are united and shuffled once by key, attribute and
    value, so a group with very many members spreads over all tasks; whether each side knows an object is a partial
    aggregate, which every member meets in one of ``SALTS`` parts of its object.  Names of objects and of attributes
    compare without regard to case, as a directory finds them, and keep the spelling of the source where it has one;
    values compare as they are.  ``op`` is ``add_object`` for attributes of objects the directory lacks, ``replace`` for differing
    single values (a null value clears), ``add_value`` and ``delete_value`` for members of multi-valued attributes.
    A row without a key names no object and has no change.  Attributes the source does not carry are left alone; objects missing or deleted in the source are the business
    of reconciliation.
    """
    if state_col in source.columns:
        source = source.where(~F.col(state_col).eqNullSafe(DELETED))
    is_multi = F.col("attribute").isin([name.lower() for name in multi_valued])
    match = [key, "attribute", "_match"]

    def side(df: DataFrame, name: str) -> DataFrame:
        value = F.struct("value", "_key", "_attribute")
        spelled = [F.col(key).alias("_key"), F.col("attribute").alias("_attribute")]
        named = F.lower(key) if isinstance(df.schema[key].dataType, T.StringType) else F.col(key)
        rows = df.select(
            named.alias(key), F.lower("attribute").alias("attribute"), "value", *spelled, F.lit(name == "s").alias("_source")
        )
        return rows.withColumn("_s", F.when(F.col("_source"), value)).withColumn("_c", F.when(~F.col("_source"), value))

    values = (
        side(source, "s")
        .unionByName(side(current, "c"))
        .withColumn("_match", F.when(is_multi, F.coalesce("value", F.lit(""))).otherwise(F.lit("")))
        .withColumn("_none", is_multi & F.col("value").isNull())  # names the object, but no member
        .groupBy(*match, "_none")
        .agg(F.max("_s").alias("_s"), F.max("_c").alias("_c"))
    )
    values = cut_lineage(values)  # both sides are computed once, for the values and for the flags of their objects
    known = values.groupBy(key).agg(
        F.bool_or(F.col("_s").isNotNull()).alias("_in_source"), F.bool_or(F.col("_c").isNotNull()).alias("_in_current")
    )
    # The members of an object share its key: each is sent to one of SALTS copies of the object's flags.
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("attribute", "_match"), F.lit(SALTS)).cast("int")
    pairs = values.where(~F.col("_none")).withColumn("_salt", salt).join(salted, [key, "_salt"])
    in_source, in_current = F.col("_s").isNotNull(), F.col("_c").isNotNull()
    op = (
        F.when(in_source & ~F.col("_in_current"), "add_object")
        .when(is_multi & in_source & ~in_current, "add_value")
        .when(is_multi & in_current & ~in_source & F.col("_in_source"), "delete_value")
        .when(~is_multi & in_source & ~F.col("_s.value").eqNullSafe(F.col("_c.value")), "replace")
    )
    row = F.coalesce("_s", "_c")
    names = [row["_key"].alias(key), op.alias("op"), row["_attribute"].alias("attribute"), row["value"].alias("value")]
    return pairs.select(*names).where(F.col("op").isNotNull())
