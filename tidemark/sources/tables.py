"""Table sources with full and delta reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import predicate, typed_literal
from tidemark.operators.merge import DELETED


def read_table(
    spark: SparkSession,
    path: str,
    cols: Sequence[str] | None = None,
    where: tuple | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scan a table extract in any Spark format (parquet, orc, csv, json, jdbc, ...), filtered and projected.

    Filter and column choice reach the scan.
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    df = reader.load() if fmt == "jdbc" else reader.load(path)
    if where is not None:
        df = df.where(predicate(df, where))
    return df.select(*cols) if cols else df


def scan_entities(df: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Only the columns the target can store, in target order and ignoring case."""
    by_name = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(by_name[t.lower()]).alias(t) for t in target_columns if t.lower() in by_name])


def delta_read(df: DataFrame, col: str, last: object, mode: str = "gt") -> DataFrame:
    """Rows after the watermark; without one the read is full.

    ``gt`` suits change times (an equal stamp was read before), ``ge`` suits update sequence numbers, where the
    boundary row is read again and the upsert absorbs it.
    """
    if mode not in ("gt", "ge"):
        raise ValueError(f"unknown delta mode {mode!r}")
    if last is None:
        return df
    bound = typed_literal(last, df.select(col).schema[0].dataType)
    return df.where(F.col(col) > bound if mode == "gt" else F.col(col) >= bound)


def next_watermark(df: DataFrame, col: str, last: object = None) -> DataFrame:
    """One row with the highest value seen; an empty read keeps the last one."""
    highest = F.max(col)
    if last is not None:
        highest = F.coalesce(highest, typed_literal(last, df.select(col).schema[0].dataType))
    return df.agg(highest.alias("watermark"))


def mark_deleted(df: DataFrame, col: str, values: Sequence[object], state_col: str = "_state") -> DataFrame:
    """Set the state Deleted where the marker column says so; other rows keep theirs or stay unclassified."""
    marked = F.when(F.col(col).isin(list(values)), DELETED)
    return df.withColumn(state_col, marked.otherwise(_known_state(df, state_col)))


def _known_state(df: DataFrame, state_col: str) -> Column:
    return F.col(state_col) if state_col in df.columns else F.lit("Unclassified")


def with_tombstones(changed: DataFrame, deleted: DataFrame, state_col: str = "_state") -> DataFrame:
    """Changed rows followed by the deleted-objects feed, whose rows are marked Deleted."""
    classified = changed.withColumn(state_col, _known_state(changed, state_col))
    return classified.unionByName(deleted.withColumn(state_col, F.lit(DELETED)), allowMissingColumns=True)
