"""Streaming upsert of the event feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import Tables, query
from tidemark.session import work_path
from tidemark.sources.tables import mark_deleted
from tidemark.streaming.upsert import compact, drop_contained, read_current, stream_upsert

FEED_SCHEMA = "user_id bigint, event_type string, ts timestamp_ntz, value double, event_id bigint, _state string"


@query(
    "stream_upsert",
    """
    SELECT user_id, event_type, ts, value, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'
    """,
)
def stream_events(t: Tables) -> DataFrame:
    """The latest event of each user, unless that is an error; the stream reads the event files as they arrive."""
    path = work_path(t.spark, "stream")
    arriving = (
        t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    )
    feed = mark_deleted(arriving, "event_type", ["error"]).select(
        "user_id", "event_type", "ts", "value", "event_id", "_state"
    )
    stream_upsert(feed, path, ["user_id"], "event_id", f"{path}/checkpoint").awaitTermination()
    return read_current(t.spark, path, FEED_SCHEMA, ["user_id"], "event_id")


@query(
    "stream_upsert_compacted",
    """
    SELECT coalesce(e.user_id, c_custkey) AS user_id,
           CASE WHEN e.user_id IS NULL THEN c_mktsegment ELSE e.event_type END AS event_type,
           CASE WHEN e.user_id IS NULL THEN c_acctbal ELSE e.value END AS value
    FROM customer FULL JOIN (
        SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) e
      ON e.user_id = c_custkey
    WHERE e.event_type IS DISTINCT FROM 'error'
    """,
)
def stream_compacted(t: Tables) -> DataFrame:
    """The event stream on top of all customers as base, read after a compaction."""
    path = work_path(t.spark, "stream")
    arriving = (
        t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    )
    feed = mark_deleted(arriving, "event_type", ["error"]).select(
        "user_id", "event_type", "value", "event_id", "_state"
    )
    schema = "user_id bigint, event_type string, value double, event_id bigint, _state string"
    base = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("event_type"),
        F.col("c_acctbal").alias("value"),
    )
    stream_upsert(feed, path, ["user_id"], "event_id", f"{path}/checkpoint").awaitTermination()
    compact(t.spark, path, schema, ["user_id"], "event_id", "2024-02-01", base)
    return read_current(t.spark, path, schema, ["user_id"], "event_id").drop("event_id")


@query(
    "stream_upsert_late_batches",
    """
    SELECT user_id, event_type, ts, value, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'
    """,
)
def stream_late(t: Tables) -> DataFrame:
    """Events arrive in several batches with the later ones first, around compactions and a new checkpoint."""
    path, keys = work_path(t.spark, "stream"), ["user_id"]
    first, last = t.events.agg(F.min("event_id"), F.max("event_id")).first()
    third = (F.lit(3) - F.floor((F.col("event_id") - first) * 3 / (last - first + 1))).cast("int")
    feed = mark_deleted(t.events, "event_type", ["error"]).withColumn("third", third)
    feed.write.partitionBy("third").parquet(f"{path}/arriving")
    for step, checkpoint in ((1, "a"), (2, "a"), (3, "b")):
        arrived = t.spark.read.schema(FEED_SCHEMA).parquet(f"{path}/arriving/third={step}")
        arrived.repartition(2).write.mode("append").parquet(f"{path}/inbox-{checkpoint}")
        source = t.spark.readStream.schema(FEED_SCHEMA).option("maxFilesPerTrigger", 1)
        arriving = source.parquet(f"{path}/inbox-{checkpoint}")
        stream_upsert(arriving, path, keys, "event_id", f"{path}/checkpoint-{checkpoint}").awaitTermination()
        if step < 3:
            compact(t.spark, path, FEED_SCHEMA, keys, "event_id", f"2024-02-0{step}")
    drop_contained(t.spark, path)
    return read_current(t.spark, path, FEED_SCHEMA, keys, "event_id")
