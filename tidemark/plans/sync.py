"""Merge, reconciliation, delta runs, change detection, audit and retention.

The target registry is made from all events, the complete source extract from all line items: the identifiers of the
two overlap, so that rows are updated, inserted and deleted.  The change feed is made from all orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changes, merge
from tidemark.operators import sync as sync_ops
from tidemark.operators.keys import latest_per_key, rejected_rows

from tidemark.plans.registry import Tables, query
from tidemark.session import work_path
from tidemark.sources import tables
from tidemark.sources.mapping import ignore_case
from tidemark.sources.state import commit_state, load_state

RUN_TS = "2024-02-01 12:00:00"

TARGET_SQL = """
    target AS (
        SELECT event_id AS id, event_type AS label, user_id AS lines, ts AS seen_at,
               CASE WHEN event_type = 'error' THEN ts END AS deleted
        FROM events),
    source AS (
        SELECT l_orderkey AS id,
               CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS label,
               count(*) AS lines, max(l_shipdate) AS seen_at
        FROM lineitem GROUP BY l_orderkey)
"""


def _target(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("label"),
        F.col("user_id").alias("lines"),
        F.col("ts").alias("seen_at"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted"),
    )


def _source(t: Tables) -> DataFrame:
    """One row per order; the label is null where its lines disagree."""
    low, high = F.min("l_returnflag"), F.max("l_returnflag")
    label = F.when(low == high, low)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        label.alias("label"), F.count(F.lit(1)).alias("lines"), F.max("l_shipdate").alias("seen_at")
    )


MERGED = """
    SELECT coalesce(s.id, t.id) AS id,
           CASE WHEN s.id IS NOT NULL THEN s.label ELSE t.label END AS label,
           CASE WHEN s.id IS NOT NULL THEN s.lines ELSE t.lines END AS lines,
           CASE WHEN s.id IS NOT NULL THEN s.seen_at ELSE t.seen_at END AS seen_at,
"""


@query(
    "merge_upsert",
    f"WITH {TARGET_SQL} {MERGED} t.deleted FROM target t FULL JOIN source s ON t.id = s.id",
)
def merge_upsert(t: Tables) -> DataFrame:
    return merge.merge_upsert(_target(t), _source(t), ["id"])


@query(
    "merge_upsert_small_batch",
    """
    SELECT coalesce(n.n_nationkey, c.c_custkey) AS id,
           CASE WHEN n.n_nationkey IS NOT NULL THEN n.n_name ELSE c.c_name END AS name, c.c_mktsegment AS segment
    FROM customer c FULL JOIN nation n ON c.c_custkey = n.n_nationkey
    """,
)
def merge_upsert_small_batch(t: Tables) -> DataFrame:
    target = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    staged = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return merge.merge_upsert(target, staged, ["id"], small_batch=True)


@query(
    "merge_key_only",
    """
    SELECT l_partkey AS id, l_suppkey AS other FROM lineitem GROUP BY ALL
    UNION SELECT event_id, user_id FROM events
    """,
)
def merge_key_only(t: Tables) -> DataFrame:
    target = t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("other")).distinct()
    staged = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("other")).distinct()
    return merge.merge_upsert(target, staged, ["id", "other"])


@query(
    "merge_counters",
    f"""
    WITH {TARGET_SQL}
    SELECT CASE WHEN t.id IS NULL THEN 'Created'
                WHEN s.id IS NULL THEN 'Unchanged'
                WHEN t.label IS NOT DISTINCT FROM s.label AND t.lines IS NOT DISTINCT FROM s.lines
                 AND t.seen_at IS NOT DISTINCT FROM s.seen_at THEN 'Unchanged'
                ELSE 'Updated' END AS _action, count(*) AS rows
    FROM target t FULL JOIN source s ON t.id = s.id GROUP BY 1
    """,
)
def merge_counters(t: Tables) -> DataFrame:
    merged = merge.merge_upsert(_target(t), _source(t), ["id"], with_action=True)
    return merged.groupBy("_action").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "rejected_rows",
    """
    WITH staged AS (SELECT nullif(l_orderkey, l_partkey) AS id, l_linenumber AS line, l_suppkey AS supplier FROM lineitem)
    SELECT coalesce(id, -1) AS id, line, supplier, CASE WHEN id IS NULL THEN 'key missing' ELSE 'key occurs twice' END AS reject_reason
    FROM staged QUALIFY id IS NULL OR count(*) OVER (PARTITION BY id, line) > 1
    """,
)
def rejected(t: Tables) -> DataFrame:
    staged = t.lineitem.select(
        F.nullif("l_orderkey", "l_partkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supplier"),
    )
    return rejected_rows(staged, ["id", "line"]).fillna(-1, ["id"])


@query(
    "merge_ignoring_case",
    """
    SELECT coalesce(t.p_name, s.name) AS name, CASE WHEN s.name IS NULL THEN t.n ELSE s.n END AS n
    FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1) t
    FULL JOIN (SELECT upper(replace(p_name, 'ring', 'knob')) AS name, CAST(max(p_size) AS BIGINT) AS n FROM part GROUP BY 1) s
      ON lower(t.p_name) = lower(s.name)
    """,
)
def merge_ignoring_case(t: Tables) -> DataFrame:
    """Part names in upper case meet their lower-case counterparts; the matched rows keep the target's spelling."""
    target = t.part.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    renamed = F.upper(F.replace("p_name", F.lit("ring"), F.lit("knob")))
    staged = t.part.groupBy(renamed.alias("name")).agg(F.max("p_size").cast("bigint").alias("n"))
    merged = merge.merge_upsert(ignore_case(target, ["name"]), ignore_case(staged, ["name"]), ["name"])
    return merged.withColumn("name", F.collate("name", "UTF8_BINARY"))


@query(
    "delete_by_key",
    f"WITH {TARGET_SQL} SELECT * FROM target WHERE id NOT IN (SELECT id FROM source WHERE label = 'R')",
)
def delete_by_key(t: Tables) -> DataFrame:
    return merge.delete_by_key(_target(t), _source(t).where(F.col("label") == "R"), ["id"])


def _feed(t: Tables) -> DataFrame:
    """The source extract as classified changes: returned orders are deletions."""
    return tables.mark_deleted(_source(t), "label", ["R"])


@query(
    "soft_delete",
    f"""
    WITH {TARGET_SQL} {MERGED}
           CASE WHEN s.id IS NULL THEN t.deleted WHEN s.label = 'R' THEN TIMESTAMP '{RUN_TS}' END AS deleted
    FROM target t FULL JOIN source s ON t.id = s.id
    """,
)
def soft_delete(t: Tables) -> DataFrame:
    return merge.apply_changes(_target(t), _feed(t), ["id"], deleted_col="deleted", run_ts=RUN_TS)


@query(
    "reinstate",
    f"""
    WITH {TARGET_SQL}
    SELECT t.id, t.deleted AS deleted_before FROM target t JOIN source s ON t.id = s.id
    WHERE t.deleted IS NOT NULL AND s.label IS DISTINCT FROM 'R'
    """,
)
def reinstate(t: Tables) -> DataFrame:
    after = soft_delete(t).where(F.col("deleted").isNull()).select("id")
    before = _target(t).where(F.col("deleted").isNotNull())
    return before.join(after, "id", "left_semi").select("id", F.col("deleted").alias("deleted_before"))


@query(
    "apply_changes",
    f"""
    WITH {TARGET_SQL} {MERGED} t.deleted FROM target t FULL JOIN source s ON t.id = s.id
    WHERE s.label IS DISTINCT FROM 'R'
    """,
)
def apply_changes(t: Tables) -> DataFrame:
    return merge.apply_changes(_target(t), _feed(t), ["id"])


@query(
    "reconcile_deletes",
    f"WITH {TARGET_SQL} SELECT * FROM target WHERE id IN (SELECT id FROM source)",
)
def reconcile_deletes(t: Tables) -> DataFrame:
    return merge.reconcile_deletes(_target(t), t.lineitem.select(F.col("l_orderkey").alias("id")), ["id"])


@query(
    "reconcile_soft_deletes",
    f"""
    WITH {TARGET_SQL}
    SELECT id, label, lines, seen_at,
           CASE WHEN deleted IS NULL AND id NOT IN (SELECT id FROM source) THEN TIMESTAMP '{RUN_TS}'
                ELSE deleted END AS deleted
    FROM target
    """,
)
def reconcile_soft_deletes(t: Tables) -> DataFrame:
    seen = t.lineitem.select(F.col("l_orderkey").alias("id"))
    return merge.reconcile_deletes(_target(t), seen, ["id"], deleted_col="deleted", run_ts=RUN_TS)


@query(
    "deletion_guard",
    f"""
    WITH {TARGET_SQL},
    c AS (SELECT count(*) AS existing, count(*) FILTER (WHERE id NOT IN (SELECT id FROM source)) AS deletions FROM target)
    SELECT existing, deletions, deletions * CAST(100 AS DOUBLE) / existing AS percent,
           deletions * CAST(100 AS DOUBLE) / existing <= 10 AS allowed
    FROM c
    """,
)
def deletion_guard(t: Tables) -> DataFrame:
    seen = t.lineitem.select(F.col("l_orderkey").alias("id"))
    return merge.deletion_guard(_target(t), seen, ["id"], 10)


FULL_SYNC = f"WITH {TARGET_SQL} SELECT s.id, s.label, s.lines, s.seen_at, t.deleted FROM source s LEFT JOIN target t ON t.id = s.id"


@query("full_sync", FULL_SYNC)
def full_sync(t: Tables) -> DataFrame:
    return sync_ops.full_sync(_target(t), _source(t), ["id"])


@query(
    "full_sync_soft",
    f"""
    WITH {TARGET_SQL} {MERGED}
           CASE WHEN s.id IS NULL THEN coalesce(t.deleted, TIMESTAMP '{RUN_TS}') END AS deleted
    FROM target t FULL JOIN source s ON t.id = s.id
    """,
)
def full_sync_soft(t: Tables) -> DataFrame:
    return sync_ops.full_sync(_target(t), _source(t), ["id"], deleted_col="deleted", run_ts=RUN_TS)


ACCOUNTS_SQL = """
    accounts AS (SELECT user_id AS id, max(value) AS amount, max(ts) AS updated FROM events GROUP BY user_id),
    latest AS (
        SELECT o_custkey AS id, o_orderstatus AS status, o_totalprice AS amount, o_orderdate AS updated
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
"""


def _accounts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("id")).agg(
        F.max("value").alias("amount"), F.max("ts").alias("updated")
    )


def _order_feed(t: Tables) -> DataFrame:
    """Every order is a change of its customer's account; a finished one deletes it."""
    feed = t.orders.select(
        F.col("o_custkey").alias("id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("updated"),
        F.col("o_orderkey").alias("_seq"),
        "o_orderstatus",
    )
    return tables.mark_deleted(feed, "o_orderstatus", ["F"]).drop("o_orderstatus")


@query(
    "delta_sync",
    f"""
    WITH {ACCOUNTS_SQL}
    SELECT coalesce(c.id, a.id) AS id, CASE WHEN c.id IS NULL THEN a.amount ELSE c.amount END AS amount,
           CASE WHEN c.id IS NULL THEN a.updated ELSE c.updated END AS updated
    FROM accounts a FULL JOIN latest c ON a.id = c.id WHERE c.status IS DISTINCT FROM 'F'
    """,
)
def delta_sync(t: Tables) -> DataFrame:
    return sync_ops.delta_sync(_accounts(t), _order_feed(t), ["id"], seq="_seq")


@query(
    "delta_sync_small_batch",
    """
    WITH accounts AS (
        SELECT o_custkey AS id, max(o_totalprice) AS amount, max(o_orderdate) AS updated FROM orders GROUP BY 1),
    latest AS (
        SELECT user_id AS id, value AS amount, ts AS updated, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT coalesce(c.id, a.id) AS id, CASE WHEN c.id IS NULL THEN a.amount ELSE c.amount END AS amount,
           CASE WHEN c.id IS NULL THEN a.updated ELSE c.updated END AS updated
    FROM accounts a FULL JOIN latest c ON a.id = c.id WHERE c.event_type IS DISTINCT FROM 'error'
    """,
)
def delta_sync_small_batch(t: Tables) -> DataFrame:
    """The latest event of each user as a delta that Spark broadcasts if its bytes allow."""
    accounts = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.max("o_totalprice").alias("amount"), F.max("o_orderdate").alias("updated")
    )
    feed = tables.mark_deleted(
        t.events.select(
            F.col("user_id").alias("id"),
            F.col("value").alias("amount"),
            F.col("ts").alias("updated"),
            F.col("event_id").alias("_seq"),
            "event_type",
        ),
        "event_type",
        ["error"],
    ).drop("event_type")
    return sync_ops.delta_sync(accounts, feed, ["id"], seq="_seq", small_batch=True)


def _delta_run(t: Tables) -> sync_ops.Run:
    return sync_ops.run_delta_sync(_accounts(t), _order_feed(t), ["id"], seq="_seq")


@query(
    "full_sync_audit",
    f"""
    WITH {TARGET_SQL}
    SELECT s.id, CASE WHEN t.id IS NULL THEN 'Created'
                      WHEN t.label IS NOT DISTINCT FROM s.label AND t.lines IS NOT DISTINCT FROM s.lines
                       AND t.seen_at IS NOT DISTINCT FROM s.seen_at THEN 'Unchanged' ELSE 'Updated' END AS _action,
           CAST(CASE WHEN t.id IS NOT NULL AND t.label IS NOT DISTINCT FROM s.label AND t.lines IS NOT DISTINCT FROM s.lines
                      AND t.seen_at IS NOT DISTINCT FROM s.seen_at THEN 0 ELSE 1 END AS BIGINT) AS row_version
    FROM source s LEFT JOIN target t ON t.id = s.id
    """,
)
def full_sync_audit(t: Tables) -> DataFrame:
    """Row versions of a full synchronisation, from the actions of its one join."""
    run = sync_ops.run_full_sync(_target(t), _source(t), ["id"])
    return changes.with_audit_columns(run.merged, RUN_TS, "sync").select("id", "_action", "row_version")


@query(
    "full_sync_counters",
    f"""
    WITH {TARGET_SQL}
    SELECT CASE WHEN t.id IS NULL THEN 'Created' WHEN s.id IS NULL THEN 'Deleted'
                WHEN t.label IS NOT DISTINCT FROM s.label AND t.lines IS NOT DISTINCT FROM s.lines
                 AND t.seen_at IS NOT DISTINCT FROM s.seen_at THEN 'Unchanged' ELSE 'Updated' END AS _state, count(*) AS rows
    FROM target t FULL JOIN source s ON t.id = s.id GROUP BY 1
    """,
)
def full_sync_counters(t: Tables) -> DataFrame:
    return changes.change_summary(sync_ops.run_full_sync(_target(t), _source(t), ["id"]).rows)


@query("full_sync_rejected", f"WITH {TARGET_SQL} SELECT * FROM target")
def full_sync_rejected(t: Tables) -> DataFrame:
    """A source in which orders with disagreeing lines have lost their key: the run publishes the target as it was."""
    source = _source(t).withColumn("id", F.when(F.col("label").isNotNull(), F.col("id")))
    return sync_ops.run_full_sync(_target(t), source, ["id"]).snapshot


@query(
    "change_summary",
    f"""
    WITH {ACCOUNTS_SQL}
    SELECT CASE WHEN a.id IS NULL THEN 'Created' WHEN c.status = 'F' THEN 'Deleted'
                WHEN c.id IS NULL OR (a.amount = c.amount AND a.updated = c.updated) THEN 'Unchanged'
                ELSE 'Updated' END AS _state, count(*) AS rows
    FROM accounts a FULL JOIN latest c ON a.id = c.id
    WHERE a.id IS NOT NULL OR c.status <> 'F' GROUP BY 1
    """,
)
def change_summary(t: Tables) -> DataFrame:
    return changes.change_summary(_delta_run(t).rows)


@query(
    "threshold_guard",
    f"""
    WITH {ACCOUNTS_SQL},
    s AS (
        SELECT CASE WHEN a.id IS NULL THEN 'Created' WHEN c.status = 'F' THEN 'Deleted'
                    WHEN c.id IS NULL OR (a.amount = c.amount AND a.updated = c.updated) THEN 'Unchanged'
                    ELSE 'Updated' END AS state
        FROM accounts a FULL JOIN latest c ON a.id = c.id WHERE a.id IS NOT NULL OR c.status <> 'F'),
    n AS (SELECT count(*) FILTER (WHERE state <> 'Created') AS existing FROM s)
    SELECT operation, rows, existing, rows * CAST(100 AS DOUBLE) / existing AS percent,
           rows * CAST(100 AS DOUBLE) / existing <= top AS allowed
    FROM (VALUES ('Updated', 90), ('Deleted', 10)) AS o(operation, top), n,
         LATERAL (SELECT count(*) AS rows FROM s WHERE state = operation)
    """,
)
def threshold_guard(t: Tables) -> DataFrame:
    return changes.threshold_guard(_delta_run(t).rows, {"Updated": 90, "Deleted": 10})


@query(
    "latest_per_key",
    """
    SELECT user_id, event_type, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def latest_per_user(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "event_type", "event_id", "ts", "value")
    return latest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "delta_gt",
    "SELECT event_id, ts FROM events WHERE ts > (SELECT min(ts) FROM events WHERE event_type = 'purchase')",
)
def delta_gt(t: Tables) -> DataFrame:
    last = t.events.where("event_type = 'purchase'").agg(F.min("ts").alias("ts")).first()["ts"]
    return tables.delta_read(t.events.select("event_id", "ts"), "ts", last)


@query("delta_ge", "SELECT event_id, user_id FROM events WHERE event_id >= 100")
def delta_ge(t: Tables) -> DataFrame:
    return tables.delta_read(t.events.select("event_id", "user_id"), "event_id", 100, mode="ge")


@query("next_watermark", "SELECT max(ts) AS watermark FROM events")
def next_watermark(t: Tables) -> DataFrame:
    return tables.next_watermark(t.events, "ts", "2024-01-01")


@query(
    "delta_run_with_state",
    """
    SELECT event_id, ts, user_id FROM events
    WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup')
    """,
)
def delta_run_with_state(t: Tables) -> DataFrame:
    """A first run commits its watermark, a failed one commits nothing, the next run reads what came after."""
    path = work_path(t.spark, "state")
    signups = t.events.where(F.col("event_type") == "signup")
    seen = tables.next_watermark(signups, "ts").select(F.col("watermark").cast("string")).first()[0]
    commit_state(t.spark, path, "events", "server-a", "ts", seen, "2024-02-01")
    commit_state(t.spark, path, "events", "server-a", "ts", "2030-01-01", "2024-02-02", had_errors=True)
    last = load_state(t.spark, path, "events", "server-a", "ts")
    return tables.delta_read(t.events.select("event_id", "ts", "user_id"), "ts", last)


SNAPSHOTS_SQL = """
    before AS (SELECT event_id AS id, event_type AS label, nullif(event_type, 'error') AS kind FROM events),
    after AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'view' WHEN 'F' THEN 'error' ELSE 'click' END AS label,
                     CASE o_orderstatus WHEN 'P' THEN 'view' END AS kind FROM orders)
"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    before = t.events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("label"),
        F.nullif("event_type", F.lit("error")).alias("kind"),
    )
    view = F.when(F.col("o_orderstatus") == "P", "view")
    after = t.orders.select(
        F.col("o_orderkey").alias("id"),
        view.when(F.col("o_orderstatus") == "F", "error").otherwise("click").alias("label"),
        view.alias("kind"),
    )
    return before, after


CLASSIFIED = f"""
    WITH {SNAPSHOTS_SQL}
    SELECT * FROM (
        SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN b.label ELSE a.label END AS label,
               CASE WHEN a.id IS NULL THEN b.kind ELSE a.kind END AS kind,
               CASE WHEN b.id IS NULL THEN 'Created' WHEN a.id IS NULL THEN 'Deleted'
                    WHEN a.label IS NOT DISTINCT FROM b.label AND a.kind IS NOT DISTINCT FROM b.kind THEN 'Unchanged'
                    ELSE 'Updated' END AS _state
        FROM before b FULL JOIN after a ON b.id = a.id)
"""


@query("classify_changes", CLASSIFIED)
def classify_changes(t: Tables) -> DataFrame:
    return changes.classify_changes(*_snapshots(t), ["id"])


@query("delta_between", f"{CLASSIFIED} WHERE _state <> 'Unchanged'")
def delta_between(t: Tables) -> DataFrame:
    return changes.delta_between(*_snapshots(t), ["id"])


@query(
    "shadow_snapshot",
    """
    SELECT c_custkey, '{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name
           || '","c_nationkey":' || c_nationkey || '}' AS shadow_json
    FROM customer
    """,
)
def shadow_snapshot(t: Tables) -> DataFrame:
    return changes.shadow_snapshot(t.customer, ["c_custkey"])


@query(
    "shadow_change_detection",
    """
    SELECT coalesce(id, c_custkey) AS id,
           CASE WHEN c_custkey IS NULL THEN 'Created' WHEN id IS NULL THEN 'Deleted'
                WHEN nation = c_nationkey AND name = c_mktsegment THEN 'Unchanged' ELSE 'Updated' END AS _state
    FROM customer FULL JOIN (
        SELECT p_partkey + 20 AS id, CASE WHEN p_size > 25 THEN c_nationkey ELSE p_size END AS nation,
               CASE WHEN p_size > 40 THEN p_brand ELSE coalesce(c_mktsegment, p_brand) END AS name
        FROM part LEFT JOIN customer ON c_custkey = p_partkey + 20) ON id = c_custkey
    """,
)
def shadow_change_detection(t: Tables) -> DataFrame:
    """Customers against rows of which some are theirs, some differ in a value, and some have other keys."""
    before = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("name")
    )
    shifted = t.part.withColumn("id", F.col("p_partkey") + 20).join(before, "id", "left")
    after = shifted.select(
        "id",
        F.when(F.col("p_size") > 25, F.col("nation")).otherwise(F.col("p_size")).alias("nation"),
        F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.coalesce("name", "p_brand")).alias("name"),
    )
    shadows = (changes.shadow_snapshot(rows, ["id"]) for rows in (before, after))
    return changes.classify_changes(*shadows, ["id"]).select("id", "_state")


@query(
    "audit_columns",
    f"""
    WITH {TARGET_SQL},
    merged AS (
        {MERGED} t.seen_at AS old_seen, t.id AS old_id,
        CASE WHEN t.id IS NULL THEN 'Created'
             WHEN s.id IS NULL OR (t.label IS NOT DISTINCT FROM s.label AND t.lines IS NOT DISTINCT FROM s.lines
                  AND t.seen_at IS NOT DISTINCT FROM s.seen_at) THEN 'Unchanged' ELSE 'Updated' END AS _action
        FROM target t FULL JOIN source s ON t.id = s.id)
    SELECT id, _action, CASE WHEN _action = 'Created' THEN TIMESTAMP '{RUN_TS}' ELSE old_seen END AS inserted,
           CASE WHEN _action = 'Created' THEN 'sync' ELSE 'loader' END AS inserted_by,
           CASE WHEN _action <> 'Unchanged' THEN TIMESTAMP '{RUN_TS}' ELSE old_seen END AS updated,
           CASE WHEN _action <> 'Unchanged' THEN 'sync' ELSE 'loader' END AS updated_by,
           CAST(CASE _action WHEN 'Updated' THEN 2 ELSE 1 END AS BIGINT) AS row_version
    FROM merged
    """,
)
def audit_columns(t: Tables) -> DataFrame:
    target = _target(t).drop("deleted").withColumns(
        {
            "inserted": F.col("seen_at"),
            "inserted_by": F.lit("loader"),
            "updated": F.col("seen_at"),
            "updated_by": F.lit("loader"),
            "row_version": F.lit(1).cast("bigint"),
        }
    )
    merged = merge.merge_upsert(target, _source(t), ["id"], with_action=True)
    audited = changes.with_audit_columns(merged, RUN_TS, "sync")
    return audited.select("id", "_action", "inserted", "inserted_by", "updated", "updated_by", "row_version")


@query(
    "purge_expired",
    """
    SELECT event_id, ts, CASE WHEN event_type = 'error' THEN ts END AS deleted FROM events
    WHERE NOT (ts < TIMESTAMP '2024-04-10' - INTERVAL 90 DAY AND event_type = 'error')
    """,
)
def purge_expired(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "ts", F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted"))
    return changes.purge_expired(events, "ts", "deleted", "2024-04-10")


@query(
    "mark_deleted",
    """
    SELECT event_id, event_type, CASE WHEN event_type IN ('error') THEN 'Deleted' ELSE 'Unclassified' END AS _state
    FROM events
    """,
)
def mark_deleted(t: Tables) -> DataFrame:
    return tables.mark_deleted(t.events.select("event_id", "event_type"), "event_type", ["error"])


@query(
    "with_tombstones",
    """
    SELECT event_id, user_id, 'Unclassified' AS _state FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, user_id, 'Deleted' FROM events WHERE event_type = 'error'
    """,
)
def with_tombstones(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type")
    changed = rows.where("event_type <> 'error'").drop("event_type")
    deleted = rows.where("event_type = 'error'").drop("event_type")
    return tables.with_tombstones(changed, deleted)


