"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that hold for any cluster size; partition counts and memory belong to the submit command.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more shuffle before a following aggregate.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the library defaults to a session builder."""
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that the driver and every executor can reach.

    It is ``spark.checkpoint.dir``; where that is unset, a folder below the warehouse, which Spark shares as well.  On a
    cluster a warehouse on a local disk is refused, as no other machine would see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if _is_machine_local(warehouse) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_tidemark_work"


def _is_machine_local(path: str) -> bool:
    return path.startswith(("file:", "/"))


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and read it back, so that lost executors do not replay its whole history."""
    path = work_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> None:
    """Delete every intermediate table below the shared folder; results that still read them must be stored first."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder) if files.exists(folder) else []:
        if re.fullmatch(r".+-[0-9a-f]{32}", status.getPath().getName()):
            files.delete(status.getPath(), True)
