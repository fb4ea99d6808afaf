"""Transactions and approvals on the conversation turns: every turn follows the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import views, workflow
from tidemark.plans.registry import Tables, query

WORK_SQL = """
    operations AS (
        SELECT DISTINCT role AS id, 'run ' || role AS name, '/' || role AS uri, 'POST' AS method,
               role = 'user' AS managed_identity, CAST(length(role) AS INTEGER) AS retry
        FROM conversations WHERE role <> 'system'),
    transactions AS (
        SELECT conv_id || '.' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '.' || (turn - 1) END AS predecessor_id,
               role AS operation_id, role = 'assistant' AS run_on_predecessor_error,
               CASE WHEN role = 'user' THEN 'w' || conv_id END AS workflow_identifier,
               CASE WHEN role = 'system' THEN TIMESTAMP '2024-01-01' END AS deleted
        FROM conversations),
    requests AS (
        SELECT conv_id || '.' || (turn + 1) AS id, role AS operation_id,
               CASE WHEN role <> 'user' THEN conv_id END AS approval_id,
               CASE WHEN length(text) > 100 THEN conv_id || '.' || (turn + 1) END AS predecessor_id
        FROM conversations),
    checked AS (
        SELECT *, CASE WHEN operation_id NOT IN (SELECT id FROM operations) THEN 'operation not found'
                       WHEN approval_id IS NOT NULL AND approval_id NOT IN (SELECT doc_id FROM labels) THEN 'approval not found'
                       WHEN predecessor_id IS NOT NULL AND predecessor_id NOT IN (SELECT id FROM transactions) THEN 'predecessor not found'
                  END AS reject_reason
        FROM requests),
    results AS (
        SELECT conv_id || '.' || turn AS transaction_id, length(text) > 60 AS completed,
               contains(text, 'er') AS has_error FROM conversations)
"""


def _id(turn: str) -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit("."), F.expr(turn).cast("string"))


def _operations(t: Tables) -> DataFrame:
    return (
        t.conversations.where("role <> 'system'")
        .select("role")
        .distinct()
        .select(
            F.col("role").alias("id"),
            F.concat(F.lit("run "), "role").alias("name"),
            F.concat(F.lit("/"), "role").alias("uri"),
            F.lit("POST").alias("method"),
            (F.col("role") == "user").alias("managed_identity"),
            F.length("role").alias("retry"),
        )
    )


def _transactions(t: Tables) -> DataFrame:
    role = F.col("role")
    return t.conversations.select(
        _id("turn").alias("id"),
        F.when(F.col("turn") > 0, _id("turn - 1")).alias("predecessor_id"),
        role.alias("operation_id"),
        (role == "assistant").alias("run_on_predecessor_error"),
        F.when(role == "user", F.concat(F.lit("w"), F.col("conv_id").cast("string"))).alias("workflow_identifier"),
        F.when(role == "system", F.lit("2024-01-01")).cast("timestamp_ntz").alias("deleted"),
    )


def _requests(t: Tables) -> DataFrame:
    """The next turn of every turn; long texts name a predecessor that often does not exist."""
    return t.conversations.select(
        _id("turn + 1").alias("id"),
        F.col("role").alias("operation_id"),
        F.when(F.col("role") != "user", F.col("conv_id")).alias("approval_id"),
        F.when(F.length("text") > 100, _id("turn + 1")).alias("predecessor_id"),
    )


def _approvals(t: Tables) -> DataFrame:
    return t.labels.select(F.col("doc_id").alias("id"))


def _results(t: Tables) -> DataFrame:
    return t.conversations.select(
        _id("turn").alias("transaction_id"),
        (F.length("text") > 60).alias("completed"),
        F.contains("text", F.lit("er")).alias("has_error"),
    )


def _created(t: Tables) -> tuple[DataFrame, DataFrame]:
    return workflow.create_transactions(_requests(t), _operations(t), _approvals(t), _transactions(t))


@query(
    "create_transactions",
    f"WITH {WORK_SQL} SELECT id, operation_id, coalesce(approval_id, -1) AS approval_id, predecessor_id FROM checked WHERE reject_reason IS NULL",
)
def create_transactions(t: Tables) -> DataFrame:
    return _created(t)[0].fillna(-1, ["approval_id"])


@query("rejected_transactions", f"WITH {WORK_SQL} SELECT * REPLACE (coalesce(approval_id, -1) AS approval_id) FROM checked WHERE reject_reason IS NOT NULL")
def rejected_transactions(t: Tables) -> DataFrame:
    return _created(t)[1].fillna(-1, ["approval_id"])


@query(
    "open_approvals",
    f"""
    WITH {WORK_SQL}
    SELECT id AS transaction_id, approval_id, 'sync' AS requester, 'st-F' AS state_id
    FROM checked WHERE reject_reason IS NULL AND approval_id IS NOT NULL
    """,
)
def open_approvals(t: Tables) -> DataFrame:
    """Order states serve as approval states, the finished one as the first."""
    names = F.when(F.col("o_orderstatus") == "F", "New").otherwise(F.col("o_orderstatus"))
    states = t.orders.select(F.concat(F.lit("st-"), "o_orderstatus").alias("state_id"), names.alias("name")).distinct()
    return workflow.open_approvals(_created(t)[0], states, "sync")


@query(
    "record_results",
    f"""
    WITH {WORK_SQL}, late AS (SELECT l.id AS transaction_id, true AS completed, false AS has_error FROM requests l
                              UNION ALL SELECT * FROM results)
    SELECT *, CASE WHEN transaction_id IN (SELECT id FROM transactions) THEN NULL ELSE 'transaction not found' END AS reject_reason
    FROM late
    """,
)
def record_results(t: Tables) -> DataFrame:
    late = _requests(t).select(
        F.col("id").alias("transaction_id"), F.lit(True).alias("completed"), F.lit(False).alias("has_error")
    )
    recorded, rejected = workflow.record_results(late.unionByName(_results(t)), _transactions(t))
    return recorded.unionByName(rejected, allowMissingColumns=True)


@query(
    "successors",
    f"""
    WITH {WORK_SQL}
    SELECT n.predecessor_id, n.id, n.operation_id FROM transactions n JOIN results r ON n.predecessor_id = r.transaction_id
    WHERE n.deleted IS NULL AND ((r.completed AND NOT r.has_error) OR (r.has_error AND n.run_on_predecessor_error))
    """,
)
def successors(t: Tables) -> DataFrame:
    return workflow.successors(_results(t), _transactions(t))


@query(
    "trigger_update",
    f"""
    WITH {WORK_SQL}
    SELECT n.id, n.operation_id, n.predecessor_id, n.run_on_predecessor_error, n.deleted,
           CASE WHEN r.completed THEN 'run-' || n.id ELSE n.workflow_identifier END AS workflow_identifier,
           o.name AS operation_name, o.uri AS operation_uri, o.method AS operation_method, o.managed_identity, o.retry
    FROM transactions n JOIN results r ON n.id = r.transaction_id JOIN operations o ON n.operation_id = o.id
    """,
)
def trigger_update(t: Tables) -> DataFrame:
    identifier = F.when(F.col("completed"), F.concat(F.lit("run-"), "transaction_id"))
    updates = _results(t).select(F.col("transaction_id").alias("id"), identifier.alias("workflow_identifier"))
    return workflow.trigger_update(_transactions(t), updates, _operations(t))[0]


@query(
    "trigger_update_rejected",
    f"""
    WITH {WORK_SQL}
    SELECT 'no-' || r.transaction_id AS id, 'run' AS workflow_identifier, 'transaction not found' AS reject_reason
    FROM results r WHERE NOT r.completed
    """,
)
def trigger_update_rejected(t: Tables) -> DataFrame:
    """Updates of transactions that do not exist, in place of those that are not completed."""
    wanted = F.when(F.col("completed"), F.col("transaction_id")).otherwise(F.concat(F.lit("no-"), "transaction_id"))
    updates = _results(t).select(wanted.alias("id"), F.lit("run").alias("workflow_identifier"))
    return workflow.trigger_update(_transactions(t), updates, _operations(t))[1]


@query(
    "transaction_detail",
    f"""
    WITH {WORK_SQL}
    SELECT n.id, n.operation_id, n.predecessor_id, n.run_on_predecessor_error, n.workflow_identifier, n.deleted,
           o.name AS operation_name, o.uri AS operation_uri, o.method AS operation_method, o.managed_identity, o.retry
    FROM transactions n JOIN operations o ON n.operation_id = o.id
    """,
)
def transaction_detail(t: Tables) -> DataFrame:
    return views.transaction_detail(_transactions(t), _operations(t))
