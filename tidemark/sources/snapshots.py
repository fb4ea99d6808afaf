"""Snapshots laid out for the next merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Save a snapshot as a table bucketed and sorted by its keys.

    A following merge on the same keys then shuffles only the staged rows, not the target.  Each bucket becomes one
    file: the rows are partitioned by key first.  Always write to a new table or path, never over the one being read.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
