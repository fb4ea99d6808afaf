"""Watermarks and delta tokens between runs, one small append-only table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import wall_clock

STATE_SCHEMA = "config_name string, source_id string, kind string, value string, updated_at timestamp_ntz, run bigint"


def load_state(spark: SparkSession, path: str, config_name: str, source_id: str, kind: str) -> str | None:
    """Last committed value, or None for a first run.

    Of entries of one time the one with the highest run number is the last.  State belongs to one source: when the latest entry came from another source, its numbers mean nothing here and
    the next read is full.
    """
    table = _table(spark, path)
    if table is None:
        return None
    latest = (
        table.where((F.col("config_name") == config_name) & (F.col("kind") == kind))
        .agg(F.max(F.struct("updated_at", "run", "source_id", "value")).alias("last"))
        .first()["last"]
    )
    return latest["value"] if latest is not None and latest["source_id"] == source_id else None


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """All entries, or None before the first one."""
    try:
        return spark.read.schema(STATE_SCHEMA).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def commit_state(
    spark: SparkSession,
    path: str,
    config_name: str,
    source_id: str,
    kind: str,
    value: str | None,
    updated_at: object,
    had_errors: bool = False,
) -> None:
    """Append the state of a finished run; a failed run, or one without a value, leaves the previous state in force."""
    if had_errors or value is None:
        return
    table = _table(spark, path)
    runs = 0 if table is None else table.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    row = spark.createDataFrame([(config_name, source_id, kind, str(value))], "c string, s string, k string, v string")
    row.select(
        F.col("c").alias("config_name"),
        F.col("s").alias("source_id"),
        F.col("k").alias("kind"),
        F.col("v").alias("value"),
        wall_clock(updated_at).alias("updated_at"),
        F.lit(runs + 1).alias("run"),
    ).coalesce(1).write.mode("append").json(path)
