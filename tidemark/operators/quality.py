"""Row checks: patterns, required fields, lengths, uniqueness, references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field patterns by kind.
PATTERNS = {
    "any": r".*",
    "digits": r"^[0-9]+$",
    "guid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "bit": r"^(0|1|true|false)$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
}


def _counts(df: DataFrame, violations: list[tuple[str, str, Column]]) -> DataFrame:
    """One scan that counts all violations, then one row per rule."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(bad).alias(f"_v{i}") for i, (_, _, bad) in enumerate(violations)]
    )
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(rule).alias("rule"),
            F.col("_rows").alias("rows"),
            F.col(f"_v{i}").alias("violations"),
        )
        for i, (name, rule, _) in enumerate(violations)
    ]
    return totals.select(F.inline(F.array(*rows)))


def validate_fields(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Violations per column of a pattern, given by name (see :data:`PATTERNS`) or as a regular expression.

    Null values are not checked.
    """
    return _counts(
        df,
        [
            (name, rule, F.col(name).isNotNull() & ~F.col(name).cast("string").rlike(PATTERNS.get(rule, rule)))
            for name, rule in rules.items()
        ],
    )


def check_schema(df: DataFrame, required: Sequence[str] = (), max_length: Mapping[str, int] | None = None) -> DataFrame:
    """Violations of required columns and of text lengths."""
    violations = [(name, "required", F.col(name).isNull()) for name in required]
    violations += [
        (name, f"max_length {limit}", F.char_length(name) > limit) for name, limit in (max_length or {}).items()
    ]
    return _counts(df, violations)


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; null counts as a value."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def check_references(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose reference (child column to parent column) names no parent; a null reference is allowed."""
    parents = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    given = child
    for name in on:
        given = given.where(F.col(name).isNotNull())
    return given.join(parents, list(on), "left_anti")
