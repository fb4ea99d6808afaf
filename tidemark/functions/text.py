"""Text measures, length buckets, hash identifiers and comment tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.decode import guid_from_hex

# The column lengths that a padded length is rounded up to; beyond the last one the column is MAX.
LENGTH_STEPS = (16, 32, 50, 100, 128, 256, 450, 512, 1024, 2048, 4000)


def has_unicode(value: Column) -> Column:
    """True when a character lies outside ASCII: then, and only then, UTF-8 needs more bytes than characters."""
    return F.octet_length(value) != F.char_length(value)


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units; only text with non-ASCII characters pays for the conversion."""
    wide = F.call_function("div", F.octet_length(F.encode(value, "UTF-16LE")), F.lit(2))
    return F.when(has_unicode(value), wide).otherwise(F.char_length(value)).cast("int")


def length_bucket(length: Column) -> Column:
    """Column length for an observed maximum: a fifth of headroom, then the next step; null means MAX."""
    padded = F.floor(length * F.lit(1.2))
    bucket = F.lit(None).cast("int")
    for step in reversed(LENGTH_STEPS):
        bucket = F.when(padded <= step, F.lit(step)).otherwise(bucket)
    return F.when(length > 0, bucket)


def hash_id(*names: Column) -> Column:
    """Stable GUID of a dotted name: MD5 over its UTF-16 bytes, in GUID byte order."""
    return guid_from_hex(F.md5(F.encode(F.concat_ws(".", *names), "UTF-16LE")))


def extract_tags(df: DataFrame, text_col: str) -> DataFrame:
    """One row per ``<!-- @Name: Value -->`` comment in ``text_col``, with the other columns kept.

    The first colon splits name from value and both are trimmed; a tag without a colon is skipped.
    """
    others = [c for c in df.columns if c != text_col]
    content = F.explode(F.regexp_extract_all(text_col, F.lit(r"(?s)<!-- @(.*?)-->"), F.lit(1)))
    found = df.where(F.contains(F.col(text_col), F.lit("<!-- @"))).select(*others, content.alias("_content"))
    colon = F.instr("_content", ":")
    return found.where(colon > 0).select(
        *others,
        F.trim(F.substring("_content", F.lit(1), colon - 1)).alias("tag_name"),
        F.trim(F.substr(F.col("_content"), colon + 1)).alias("tag_value"),
    )
