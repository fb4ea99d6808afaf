import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.operators.changes import (
    change_summary,
    classify_changes,
    delta_between,
    purge_expired,
    shadow_snapshot,
    threshold_guard,
    with_audit_columns,
)
from tidemark.operators.keys import latest_per_key, rejected_rows
from tidemark.operators.sync import DeletionThresholdExceeded, RowsRejected, delta_sync, full_sync, run_delta_sync, run_full_sync
from tidemark.sources.mapping import ignore_case
from tidemark.sources.snapshots import write_bucketed

RUN = "2024-05-01 10:00:00"
STAMP = dt.datetime(2024, 5, 1, 10)


def frame(spark, data, schema="id int, name string, mail string"):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def target(spark):
    return frame(spark, [(1, "one", "a@x"), (2, "two", "b@x"), (None, "loose", None)])


def test_upsert_updates_inserts_and_keeps(spark, target, rows):
    staged = frame(spark, [(2, None, "new"), (3, "three", "c@x"), (None, "other", None)])
    want = [
        (1, "one", "a@x"),
        (2, None, "new"),  # a staged null overwrites
        (3, "three", "c@x"),
        (None, "loose", None),  # null keys never match
        (None, "other", None),
    ]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert rows(merge.merge_upsert(target, staged, ["id"])) == sorted(want, key=key)
    assert rows(merge.merge_upsert(target, staged, ["id"], small_batch=True)) == sorted(want, key=key)


def test_columns_that_are_not_staged_survive(spark, target, rows):
    staged = frame(spark, [(1, "uno"), (4, "four")], "id int, name string")
    out = rows(merge.merge_upsert(target, staged, ["id"]).where("id IS NOT NULL"))
    assert out == [(1, "uno", "a@x"), (2, "two", "b@x"), (4, "four", None)]


def test_composite_key_needs_both_parts(spark, rows):
    target = frame(spark, [("t1", 1, "a"), ("t2", 1, "b")], "tenant string, id int, name string")
    staged = frame(spark, [("t1", 1, "new"), ("t1", 2, "ins")], "tenant string, id int, name string")
    assert rows(merge.merge_upsert(target, staged, ["tenant", "id"])) == [("t1", 1, "new"), ("t1", 2, "ins"), ("t2", 1, "b")]


def test_key_only_table_inserts_only(spark, rows):
    target = frame(spark, [("t", 1), ("t", 2)], "tenant string, id int")
    staged = frame(spark, [("t", 2), ("u", 2)], "tenant string, id int")
    assert rows(merge.merge_upsert(target, staged, ["tenant", "id"])) == [("t", 1), ("t", 2), ("u", 2)]


def test_unknown_column_is_an_error(spark, target):
    with pytest.raises(ValueError, match="no column"):
        merge.merge_upsert(target, frame(spark, [(1, "x")], "id int, nope string"), ["id"])


@pytest.mark.parametrize("small_batch", [False, True])
def test_a_repeated_staged_key_fails(spark, target, small_batch):
    staged = frame(spark, [(2, "x", None), (2, "y", None)])
    with pytest.raises(PySparkException, match="a key occurs twice"):
        merge.merge_upsert(target, staged, ["id"], small_batch=small_batch).collect()


def test_rejected_rows(spark, rows):
    df = frame(spark, [(1, "a", None), (1, "b", None), (None, "c", None), (2, "d", None)])
    assert rows(rejected_rows(df, ["id"]), "name", "reject_reason") == [
        ("a", "key occurs twice"),
        ("b", "key occurs twice"),
        ("c", "key missing"),
    ]


def test_keys_may_ignore_case(spark, rows):
    target = ignore_case(frame(spark, [("Ann", 1), ("Bob", 2)], "name string, n int"), ["name"])
    staged = ignore_case(frame(spark, [("ANN", 9), ("cid", 3)], "name string, n int"), ["name"])
    assert rows(merge.merge_upsert(target, staged, ["name"])) == [("Ann", 9), ("Bob", 2), ("cid", 3)]
    assert rows(target.where("name = 'BOB'"), "n") == [(2,)]


def test_upsert_twice_equals_once(spark, target, rows):
    staged = frame(spark, [(2, "x", None), (3, "y", "z")])
    once = merge.merge_upsert(target, staged, ["id"])
    assert rows(merge.merge_upsert(once, staged, ["id"])) == rows(once)


def test_actions(spark, target, rows):
    staged = frame(spark, [(1, "one", "a@x"), (2, "two", None), (3, "new", None)])
    out = merge.merge_upsert(target.where("id IS NOT NULL"), staged, ["id"], with_action=True)
    assert rows(out, "id", "_action") == [(1, "Unchanged"), (2, "Updated"), (3, "Created")]


def test_delete_by_key(spark, target, rows):
    dead = frame(spark, [(1,), (7,), (None,)], "id int")
    assert rows(merge.delete_by_key(target, dead, ["id"]), "id") == [(2,), (None,)]


CHANGES = "id int, name string, mail string, _state string, seq int"


@pytest.mark.parametrize("small_batch", [False, True])
def test_latest_change_decides(spark, target, rows, small_batch):
    changes = frame(
        spark,
        [
            (1, "n1", None, "Updated", 1),
            (1, "n2", None, "Deleted", 2),
            (2, "x", None, "Deleted", 1),
            (2, "back", "m", "Created", 2),
            (5, "never", None, "Deleted", 1),
            (6, "tie", None, "Updated", 1),
            (6, "tie", None, "Deleted", 1),
        ],
        CHANGES,
    )
    out = merge.apply_changes(target, changes, ["id"], seq="seq", small_batch=small_batch)
    assert rows(out) == [(2, "back", "m"), (None, "loose", None)]


def test_without_sequence_the_deletion_wins(spark, target, rows):
    changes = frame(
        spark, [(1, "x", "y", "Updated"), (1, "x", "y", "Deleted"), (3, "z", None, "Created")], CHANGES[: -len(", seq int")]
    )
    assert rows(merge.apply_changes(target, changes, ["id"]), "id") == [(2,), (3,), (None,)]


def test_two_upserts_of_one_key_fail(spark, target):
    changes = frame(spark, [(1, "x", "y", "Updated"), (1, "z", "y", "Updated")], CHANGES[: -len(", seq int")])
    with pytest.raises(PySparkException, match="several upserts of one key"):
        merge.apply_changes(target, changes, ["id"]).collect()


def test_soft_delete_and_reinstate(spark, rows):
    target = frame(spark, [(1, "a", None), (2, "b", dt.datetime(2023, 1, 1))], "id int, name string, deleted timestamp_ntz")
    changes = frame(
        spark,
        [(1, "a", "Deleted"), (2, "back", "Updated"), (3, "new", "Deleted")],
        "id int, name string, _state string",
    )
    out = merge.apply_changes(target, changes, ["id"], deleted_col="deleted", run_ts=RUN)
    assert rows(out) == [(1, "a", STAMP), (2, "back", None), (3, "new", STAMP)]


def test_reconcile(spark, rows):
    target = frame(
        spark,
        [(1, None), (2, None), (3, dt.datetime(2023, 1, 1)), (None, None)],
        "id int, deleted timestamp_ntz",
    )
    seen = frame(spark, [(1,), (1,), (9,)], "id int")
    assert rows(merge.reconcile_deletes(target, seen, ["id"]), "id") == [(1,), (None,)]
    soft = merge.reconcile_deletes(target, seen, ["id"], "deleted", RUN)
    assert rows(soft) == [(1, None), (2, STAMP), (3, dt.datetime(2023, 1, 1)), (None, None)]


@pytest.mark.parametrize(("missing", "allowed"), [(10, True), (11, False), (0, True)])
def test_guard_is_strict(spark, missing, allowed):
    target, seen = spark.range(100), spark.range(missing, 200)
    row = merge.deletion_guard(target, seen, ["id"], 10).first()
    assert (row.existing, row.deletions, row.percent, row.allowed) == (100, missing, float(missing), allowed)


def test_thresholds_by_operation(spark, rows):
    old = spark.range(10).selectExpr("id", "'a' AS v")
    new = spark.range(1, 13).selectExpr("id", "if(id < 4, 'b', 'a') AS v")
    states = classify_changes(old, new, ["id"])
    out = threshold_guard(states, {"Created": 20, "Updated": 29.9, "Deleted": 10}, "_state")
    assert rows(out) == [("Created", 3, 10, 30.0, False), ("Deleted", 1, 10, 10.0, True), ("Updated", 3, 10, 30.0, False)]
    empty = threshold_guard(classify_changes(old.limit(0), new, ["id"]), {"Deleted": 0}, "_state")
    assert rows(empty) == [("Deleted", 0, 0, 0.0, True)]


def test_guard_on_an_empty_target(spark):
    row = merge.deletion_guard(spark.range(0), spark.range(3), ["id"], 10).first()
    assert (row.existing, row.percent, row.allowed) == (0, 0.0, True)


def test_full_sync_makes_the_keys_equal(spark, rows):
    target = frame(spark, [(i, f"n{i}") for i in range(20)] + [(None, "loose")], "id int, name string")
    source = frame(spark, [(i, "new") for i in range(1, 22)], "id int, name string")
    assert rows(full_sync(target, source, ["id"]), "id") == sorted(
        [(i,) for i in range(1, 22)] + [(None,)], key=lambda r: (r[0] is None, str(r[0]))
    )
    with pytest.raises(DeletionThresholdExceeded, match="20 of 20"):
        full_sync(target, source.limit(0), ["id"])
    assert full_sync(target, source.limit(0), ["id"], percentage=None).count() == 1


def test_full_sync_soft(spark, rows):
    target = frame(
        spark,
        [(1, "a", None), (2, "b", None), (3, "c", dt.datetime(2023, 1, 1)), (4, "d", dt.datetime(2023, 1, 1))],
        "id int, name string, deleted timestamp_ntz",
    )
    source = frame(spark, [(1, "a2"), (3, "c2"), (5, "e")], "id int, name string")
    out = full_sync(target, source, ["id"], percentage=None, deleted_col="deleted", run_ts=RUN)
    assert rows(out) == [
        (1, "a2", None),
        (2, "b", STAMP),
        (3, "c2", None),
        (4, "d", dt.datetime(2023, 1, 1)),
        (5, "e", None),
    ]
    with pytest.raises(DeletionThresholdExceeded, match="1 of 2"):  # only live rows count
        full_sync(target, source, ["id"], deleted_col="deleted", run_ts=RUN)


def test_delta_sync_never_reconciles(spark, target, rows):
    changes = frame(spark, [(2, "x", "y", "Updated")], CHANGES[: -len(", seq int")])
    assert rows(delta_sync(target, changes, ["id"]), "id") == [(1,), (2,), (None,)]


def test_random_histories_match_a_dictionary(spark, rows):
    """A third of all changes hit one key."""
    rng = random.Random(7)
    state = {i: f"t{i}" for i in range(40)}
    target = frame(spark, list(state.items()), "id int, name string")
    log = []
    for seq in range(1500):
        key = 7 if rng.random() < 0.34 else rng.randrange(80)
        deleted = rng.random() < 0.3
        log.append((key, f"v{seq}", "Deleted" if deleted else "Updated", seq))
        state.pop(key, None)
        if not deleted:
            state[key] = f"v{seq}"
    rng.shuffle(log)
    changes = frame(spark, log, "id int, name string, _state string, seq int")
    want = sorted(state.items(), key=lambda r: str(r[0]))
    assert rows(delta_sync(target, changes, ["id"], seq="seq")) == want
    assert rows(delta_sync(target, changes, ["id"], seq="seq", small_batch=True)) == want


def test_classification(spark, rows):
    old = frame(spark, [(1, "a", None), (2, "b", "x"), (3, "c", "y"), (5, None, None)])
    new = frame(spark, [(1, "a", None), (2, "b", None), (4, "d", "z"), (5, None, None)])
    assert rows(classify_changes(old, new, ["id"]), "id", "_state") == [
        (1, "Unchanged"),
        (2, "Updated"),
        (3, "Deleted"),
        (4, "Created"),
        (5, "Unchanged"),
    ]
    deleted = delta_between(old, new, ["id"]).where("_state = 'Deleted'").first()
    assert (deleted.id, deleted.name, deleted.mail) == (3, "c", "y")
    assert rows(change_summary(classify_changes(old, new, ["id"]), "_state")) == [("Created", 1), ("Deleted", 1), ("Unchanged", 2), ("Updated", 1)]


def test_classification_of_maps_and_variants(spark, rows):
    def bag(text):
        return spark.range(1).select("id", F.parse_json(F.lit(text)).alias("v"), F.create_map(F.lit("k"), F.lit(text)).alias("m"))

    assert rows(classify_changes(bag('{"a":1}'), bag('{"a":1}'), ["id"]), "_state") == [("Unchanged",)]
    assert rows(classify_changes(bag('{"a":1}'), bag('{"a":2}'), ["id"]), "_state") == [("Updated",)]


def test_delta_applied_to_the_old_snapshot_gives_the_new_one(spark, rows):
    old = frame(spark, [(1, "a", None), (2, "b", "x"), (3, "c", "y")])
    new = frame(spark, [(1, "a", None), (2, "z", None), (4, "d", "z")])
    assert rows(delta_sync(old, delta_between(old, new, ["id"]), ["id"])) == rows(new)


def test_shadow(spark):
    out = shadow_snapshot(frame(spark, [(1, "a", None)]), ["id"]).first()
    assert out.shadow_json == '{"id":1,"name":"a"}'


def test_audit_columns(spark):
    target = frame(spark, [(1, "a"), (2, "b")], "id int, name string")
    first = with_audit_columns(merge.merge_upsert(target.limit(0), target, ["id"], with_action=True), RUN, "me").drop("_action")
    staged = frame(spark, [(1, "a"), (2, "B"), (3, "c")], "id int, name string")
    later = with_audit_columns(merge.merge_upsert(first, staged, ["id"], with_action=True), "2024-06-01", "you")
    got = {r.id: r for r in later.collect()}
    june = dt.datetime(2024, 6, 1)
    assert (got[1].inserted, got[1].updated, got[1].updated_by, got[1].row_version) == (STAMP, STAMP, "me", 1)
    assert (got[2].inserted, got[2].updated, got[2].updated_by, got[2].row_version) == (STAMP, june, "you", 2)
    assert (got[3].inserted, got[3].inserted_by, got[3].row_version) == (june, "you", 1)


def test_purge_boundary(spark, rows):
    day = dt.datetime(2024, 4, 10)
    old, edge = day - dt.timedelta(days=91), day - dt.timedelta(days=90)
    df = frame(
        spark,
        [(1, old, day), (2, old, None), (3, edge, day), (4, None, day)],
        "id int, inserted timestamp_ntz, deleted timestamp_ntz",
    )
    assert rows(purge_expired(df, "inserted", "deleted", "2024-04-10"), "id") == [(2,), (3,), (4,)]


def test_latest_per_key_reduces_before_the_shuffle(spark, rows, plan_of):
    df = spark.range(3000).select((F.col("id") % 3 * F.col("id") % 50).alias("k"), F.col("id").alias("seq"))
    out = latest_per_key(df, ["k"], "seq")
    before_shuffle = plan_of(out).split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
    want = sorted(((r.k, r.seq) for r in df.groupBy("k").agg(F.max("seq").alias("seq")).collect()), key=str)
    assert sorted(((r.k, r.seq) for r in out.collect()), key=str) == want


def test_null_keys_are_not_deduplicated(spark, rows):
    df = frame(spark, [(None, 1), (None, 2), (1, 1), (1, 3)], "k int, seq int")
    assert rows(latest_per_key(df, ["k"], "seq")) == [(1, 3), (None, 1), (None, 2)]


def test_small_batch_leaves_the_target_unshuffled(spark, plan_of):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus")
    staged = orders.limit(5)
    plan = plan_of(merge.merge_upsert(orders, staged, ["o_orderkey"], small_batch=True))
    assert "SortMergeJoin" not in plan and "FullOuter" not in plan
    general = plan_of(merge.merge_upsert(orders, staged, ["o_orderkey"]))
    assert "FullOuter" in general


def test_bucketed_snapshot_is_not_shuffled_again(spark, plan_of, rows):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus")
    write_bucketed(orders, "orders_snapshot", ["o_orderkey"], 8)
    target = spark.table("orders_snapshot")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    staged = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))
    out = merge.merge_upsert(target, staged, ["o_orderkey"], complete_keys=True)
    joined = plan_of(out).split("FullOuter")[1].split("FileScan")[1:]
    target_side = plan_of(out).split("FullOuter")[1].split("FileScan")[0]
    assert joined and "Exchange" not in target_side
    assert rows(out) == rows(merge.merge_upsert(orders, staged, ["o_orderkey"]))


def once(plan):
    """Scans and shuffles of a plan, by input file or shuffle."""
    return plan.count("FileScan"), plan.count("Exchange hashpartitioning")


@pytest.fixture
def as_at_scale(spark):
    """Nothing is small enough to broadcast or to share a partition."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_every_input_is_read_and_shuffled_once(spark, plan_of, as_at_scale):
    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(F.nullif("o_orderkey", F.lit(3)).alias("k"), "o_orderdate")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.nullif("l_orderkey", F.lit(5)).alias("k"), F.col("l_shipdate").alias("o_orderdate"), F.col("l_linenumber").alias("_seq"))
    staged = lines.drop("_seq")
    feed = lines.withColumn("_state", F.lit("Updated"))
    assert once(plan_of(merge.merge_upsert(orders, staged, ["k"]))) == (2, 2)
    assert once(plan_of(merge.apply_changes(orders, feed, ["k"], seq="_seq"))) == (2, 2)
    assert once(plan_of(delta_sync(orders, feed, ["k"], seq="_seq", run_ts=RUN))) == (2, 2)
    assert once(plan_of(merge.delete_by_key(orders, staged, ["k"]))) == (2, 2)
    assert once(plan_of(merge.insert_missing(orders, staged, ["k"]))) == (3, 2)  # the target itself, and its keys


def test_rows_without_a_key_spread(spark, as_at_scale):
    target = spark.range(0, 40_000, 1, 8).selectExpr("if(id % 3 = 0, null, id) AS k", "id AS v")
    out = merge.merge_upsert(target, target.where("k IS NULL"), ["k"])
    sizes = [r["n"] for r in out.where("k IS NULL").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2 * 13_334 and max(sizes) < 0.4 * sum(sizes)
    plain = spark.range(100).selectExpr("if(id < 90, null, id) AS k")
    for out in (merge.delete_by_key(target, plain, ["k"]), merge.reconcile_deletes(target, plain, ["k"])):
        sizes = [r["n"] for r in out.where("k IS NULL").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 13_334 and max(sizes) < 0.4 * sum(sizes)


def test_landed_pages_are_parsed_once(spark, plan_of, tmp_path):
    from tidemark.sources.pages import read_pages

    spark.createDataFrame([('[{"id":1,"name":"a"},{"id":null,"name":"b"}]',)], "value string").write.parquet(f"{tmp_path}/p")
    staged = read_pages(spark.read.parquet(f"{tmp_path}/p"), item_schema="id int, name string")
    target = spark.read.parquet("/root/testdata/sf0.001/region.parquet").selectExpr("r_regionkey AS id", "r_name AS name")
    plan = plan_of(merge.merge_upsert(target, staged, ["id"]))
    assert plan.count("from_json") == plan.count("Generate inline") == 1
    assert merge.merge_upsert(target, staged, ["id"]).count() == 6


def test_run_counts_audit_and_rejects(spark, rows):
    target = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (None, "loose")], "id int, name string")
    source = frame(spark, [(1, "a"), (2, "B"), (4, "d")], "id int, name string")
    run = run_full_sync(target, source, ["id"], percentage=50)
    assert run.counts == {"Unchanged": 2, "Updated": 1, "Created": 1, "Deleted": 1} and not run.failed
    assert rows(run.snapshot) == [(1, "a"), (2, "B"), (4, "d"), (None, "loose")]
    stamped = {r.id: r for r in with_audit_columns(run.merged, RUN, "me").collect()}
    assert stamped[4].inserted == STAMP and stamped[2].updated == STAMP and stamped[1].updated is None
    bad = run_full_sync(target, source.union(frame(spark, [(None, "x")], "id int, name string")), ["id"])
    assert bad.failed and rows(bad.rejected) == [(None, "x")] and rows(bad.snapshot) == rows(target)
    assert bad.merged.count() == 0
    with pytest.raises(RowsRejected):
        full_sync(target, source.union(frame(spark, [(None, "x")], "id int, name string")), ["id"])


def test_rejected_run_commits_no_state(spark, tmp_path):
    from tidemark.sources.state import load_state

    target = frame(spark, [(1, "a")], "id int, name string")
    path = f"{tmp_path}/state"
    good = run_delta_sync(target, frame(spark, [(1, "b", "Updated"), (2, "c", "Deleted")], "id int, name string, _state string"), ["id"])
    good.commit(spark, path, "c", "s", "k", "9", RUN)
    bad = run_delta_sync(target, frame(spark, [(None, "b", "Updated")], "id int, name string, _state string"), ["id"])
    bad.commit(spark, path, "c", "s", "k", "10", RUN)
    assert good.counts == {"Updated": 1} and bad.failed
    assert load_state(spark, path, "c", "s", "k") == "9"


def test_repeated_full_syncs_do_not_pile_up(spark, rows):
    target = frame(spark, [(1, "a"), (None, "loose")], "id int, name string")
    source = frame(spark, [(1, "b")], "id int, name string")
    once_more = full_sync(full_sync(target, source, ["id"]), source, ["id"])
    assert rows(once_more) == [(1, "b"), (None, "loose")]


@pytest.mark.parametrize(
    "call",
    [
        lambda t, s: merge.apply_changes(t, s.withColumn("_state", F.lit("Deleted")), ["id"], deleted_col="deleted"),
        lambda t, s: merge.reconcile_deletes(t, s, ["id"], deleted_col="deleted"),
        lambda t, s: full_sync(t, s, ["id"], deleted_col="deleted"),
    ],
)
def test_soft_deletes_need_their_time(spark, call):
    target = frame(spark, [(1, None)], "id int, deleted timestamp_ntz")
    with pytest.raises(ValueError, match="run_ts"):
        call(target, target.select("id"))


def test_full_sync_refuses_unknown_columns(spark, target):
    with pytest.raises(ValueError, match="no column"):
        full_sync(target, frame(spark, [(1, "x")], "id int, nope string"), ["id"])


def test_classification_needs_unique_keys(spark):
    twice, single = frame(spark, [(1, "a", None), (1, "b", None)]), frame(spark, [(1, "a", None)])
    for old, new in ((twice, single), (single, twice)):
        with pytest.raises(PySparkException, match="a key occurs twice"):
            classify_changes(old, new, ["id"]).collect()


def test_equal_values_of_every_type(spark, rows):
    kinds = "id int, m map<string,int>, s struct<a:int,m:map<string,array<int>>>, l array<map<string,int>>"
    old = frame(spark, [(1, {"a": 1, "b": 2}, (1, {"x": [1], "y": [2]}), [{"p": 1, "q": 2}])], kinds)
    new = frame(spark, [(1, {"b": 2, "a": 1}, (1, {"y": [2], "x": [1]}), [{"q": 2, "p": 1}])], kinds)
    other = frame(spark, [(1, {"b": 2, "a": 1}, (1, {"y": [2], "x": [3]}), [{"q": 2, "p": 1}])], kinds)
    assert rows(classify_changes(old, new, ["id"]), "_state") == [("Unchanged",)]
    assert rows(classify_changes(old, other, ["id"]), "_state") == [("Updated",)]
    assert shadow_snapshot(old, ["id"]).first().shadow_json == shadow_snapshot(new, ["id"]).first().shadow_json

    def bags(text):
        return spark.range(1).select("id", F.array(F.parse_json(F.lit(text))).alias("v"))

    assert rows(classify_changes(bags('{"a":1}'), bags('{"a":1}'), ["id"]), "_state") == [("Unchanged",)]
    assert rows(classify_changes(bags('{"a":1}'), bags('{"a":2}'), ["id"]), "_state") == [("Updated",)]


def test_of_several_deletions_the_choice_is_fixed(spark, rows):
    target = frame(spark, [(1, "a", None)], "id int, name string, deleted timestamp_ntz")
    dead = [(1, name, "Deleted") for name in ("x", "z", "y")]
    for order in (dead, dead[::-1]):
        changes = frame(spark, order, "id int, name string, _state string").repartition(3)
        out = merge.apply_changes(target, changes, ["id"], deleted_col="deleted", run_ts=RUN)
        assert rows(out) == [(1, "z", STAMP)]


def test_platform_tables_keep_what_rows_lack(spark):
    from tidemark.operators.platform import into_platform
    from tidemark.schemas import schema

    empty = spark.createDataFrame([], schema("role"))
    first = frame(spark, [("r1", "v1", True), ("r2", "v2", False)], "id string, Value string, enabled boolean")
    once = into_platform(empty, first, "role", ["id"], RUN, "me")
    twice = into_platform(once, frame(spark, [("r1", "Reader"), ("r3", "New")], "id string, display string"), "role", ["id"], "2024-06-01", "you")
    got = {r.id: (r.value, r.display, r.enabled, r.inserted_by, r.row_version) for r in twice.collect()}
    assert twice.columns == schema("role").names
    assert got == {"r1": ("v1", "Reader", True, "me", 2), "r2": ("v2", None, False, "me", 1), "r3": (None, "New", None, "you", 1)}
