import random

from pyspark.sql import functions as F

from tidemark.session import work_path
from tidemark.streaming.upsert import compact, drop_contained, read_current, stream_upsert

SCHEMA = "id bigint, name string, seq bigint, _state string"


class Feed:
    """A change feed that arrives as files, and the dictionary it should lead to."""

    def __init__(self, spark, seed=3):
        self.spark, self.rng = spark, random.Random(seed)
        self.path, self.inbox = work_path(spark, "test-stream"), work_path(spark, "test-inbox")
        self.state, self.seq = {}, 0

    def arrive(self, n):
        log = []
        for _ in range(n):
            self.seq += 1
            key = 1 if self.rng.random() < 0.34 else self.rng.randrange(30)
            deleted = self.rng.random() < 0.3
            log.append((key, f"v{self.seq}", self.seq, "Deleted" if deleted else "Updated"))
            self.state.pop(key, None)
            if not deleted:
                self.state[key] = f"v{self.seq}"
        self.rng.shuffle(log)
        self.spark.createDataFrame(log, SCHEMA).coalesce(1).write.mode("append").parquet(self.inbox)

    def run(self):
        changes = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.inbox)
        stream_upsert(changes, self.path, ["id"], "seq", f"{self.path}/checkpoint").awaitTermination()

    def current(self, base=None):
        out = read_current(self.spark, self.path, SCHEMA, ["id"], "seq", base)
        return {r.id: r.name for r in out.collect()}


def test_batches_and_compaction(spark):
    feed = Feed(spark)
    feed.arrive(60)
    feed.arrive(60)
    feed.run()
    assert feed.current() == feed.state
    feed.run()  # nothing new arrived
    assert feed.current() == feed.state

    compact(spark, feed.path, SCHEMA, ["id"], "seq", "2024-01-01")
    assert feed.current() == feed.state
    feed.arrive(40)
    feed.run()
    assert feed.current() == feed.state
    compact(spark, feed.path, SCHEMA, ["id"], "seq", "2024-01-02")
    assert feed.current() == feed.state


def test_changes_on_a_base(spark):
    feed = Feed(spark, seed=5)
    base = spark.range(25, 40).select("id", F.lit("base").alias("name"))
    feed.state = {i: "base" for i in range(25, 40)}
    assert read_current(spark, feed.path, SCHEMA, ["id"], "seq", base).count() == 15
    feed.arrive(50)
    feed.run()
    assert feed.current(base) == feed.state
    compact(spark, feed.path, SCHEMA, ["id"], "seq", "2024-01-01", base)
    assert feed.current() == feed.state


def test_empty_target(spark):
    path = work_path(spark, "test-stream")
    assert read_current(spark, path, SCHEMA, ["id"], "seq") is None
    compact(spark, path, SCHEMA, ["id"], "seq", "2024-01-01")
    assert read_current(spark, path, SCHEMA, ["id"], "seq") is None


def test_a_replayed_feed_changes_nothing(spark):
    """A stream that lost its checkpoint processes every file again, in batches of the same numbers."""
    feed = Feed(spark, seed=9)
    for _ in range(3):
        feed.arrive(30)
    feed.run()
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed.inbox)
    stream_upsert(changes, feed.path, ["id"], "seq", f"{feed.path}/checkpoint-2").awaitTermination()
    assert feed.current() == feed.state


def change(spark, feed, *rows, checkpoint="checkpoint", inbox=None):
    """Let rows arrive and run the stream over them."""
    inbox = inbox or feed.inbox
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
    stream_upsert(changes, feed.path, ["id"], "seq", f"{feed.path}/{checkpoint}").awaitTermination()


def test_compacting_twice_keeps_the_base(spark):
    feed = Feed(spark)
    change(spark, feed, (1, "a", 1, "Created"))
    for at in ("2024-01-01", "2024-01-01", "2024-01-02"):
        compact(spark, feed.path, SCHEMA, ["id"], "seq", at)
        assert feed.current() == {1: "a"}


def test_a_new_checkpoint_after_a_compaction(spark):
    feed = Feed(spark)
    for seq in range(3):
        change(spark, feed, (1, f"v{seq}", seq, "Updated"))
    compact(spark, feed.path, SCHEMA, ["id"], "seq", "2024-01-01")
    change(spark, feed, (1, "new", 99, "Updated"), checkpoint="second", inbox=f"{feed.inbox}-2")
    assert feed.current() == {1: "new"}
    compact(spark, feed.path, SCHEMA, ["id"], "seq", "2024-01-02")
    drop_contained(spark, feed.path)
    assert feed.current() == {1: "new"}


def test_late_and_equal_changes_do_not_depend_on_compaction(spark):
    first = [(1, "new", 10, "Updated"), (2, "dead", 10, "Deleted"), (3, "b", 5, "Updated"), (4, "x", 5, "Updated")]
    later = [(1, "stale", 5, "Updated"), (2, "stale", 9, "Updated"), (3, "a", 5, "Updated"), (4, "x", 5, "Deleted")]
    results = []
    for compacted in (False, True):
        feed = Feed(spark)
        change(spark, feed, *first)
        if compacted:
            compact(spark, feed.path, SCHEMA, ["id"], "seq", "2024-01-01")
            drop_contained(spark, feed.path)
        change(spark, feed, *later)
        results.append(feed.current())
    assert results == [{1: "new", 3: "b"}] * 2


def test_state_of_equal_times(spark):
    from tidemark.sources.state import commit_state, load_state

    path = work_path(spark, "test-state")
    for value in ("9", "10", "9", "10"):
        commit_state(spark, path, "c", "s", "k", value, "2024-01-01")
        assert load_state(spark, path, "c", "s", "k") == value
