"""Transactions, approvals and results, as set rules over whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keys import join_spread
from tidemark.operators.read import live_rows
from tidemark.operators.views import transaction_detail
from tidemark.session import cut_lineage


def check_requests(
    requests: DataFrame, operations: DataFrame, approvals: DataFrame, transactions: DataFrame
) -> DataFrame:
    """Requests with ``reject_reason``: the first failing existence check, null when accepted.

    A request names an ``operation_id`` and optionally an ``approval_id`` and a ``predecessor_id``; a predecessor
    must exist before the batch.  Each lookup side holds one row per id, so the joins keep one row per request.  The
    many requests without approval or predecessor spread over all tasks.
    """
    checked = requests
    for df, name in ((operations, "operation"), (approvals, "approval"), (transactions, "predecessor")):
        key = f"{name}_id"
        ids = df.select(F.col("id").alias(key)).distinct().withColumn(f"_{name}", F.lit(True))
        checked = join_spread(checked, ids, key)
    reason = (
        F.when(F.col("_operation").isNull(), "operation not found")
        .when(F.col("approval_id").isNotNull() & F.col("_approval").isNull(), "approval not found")
        .when(F.col("predecessor_id").isNotNull() & F.col("_predecessor").isNull(), "predecessor not found")
    )
    return checked.select(*requests.columns, reason.alias("reject_reason"))


def create_transactions(
    requests: DataFrame, operations: DataFrame, approvals: DataFrame, transactions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, which become transactions, and rejected ones with their reason; checked and stored once."""
    checked = cut_lineage(check_requests(requests, operations, approvals, transactions))
    return (
        checked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.where(F.col("reject_reason").isNotNull()),
    )


def open_approvals(accepted: DataFrame, states: DataFrame, requester: str, new_state: str = "New") -> DataFrame:
    """An approval request in the first state for every accepted transaction that names an approval.

    Without a row for that state none is opened.
    """
    first = states.where(F.col("name") == new_state).agg(F.max("state_id")).scalar()
    return (
        accepted.where(F.col("approval_id").isNotNull())
        .select(F.col("id").alias("transaction_id"), "approval_id", F.lit(requester).alias("requester"))
        .withColumn("state_id", first)
        .where(F.col("state_id").isNotNull())
    )


def record_results(results: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of existing transactions, to be appended, and those of unknown ones."""
    ids = transactions.select(F.col("id").alias("transaction_id")).distinct().withColumn("_known", F.lit(True))
    marked = cut_lineage(join_spread(results, ids, "transaction_id"))
    return (
        marked.where("_known").drop("_known"),
        marked.where("_known IS NULL").drop("_known").withColumn("reject_reason", F.lit("transaction not found")),
    )


def successors(results: DataFrame, transactions: DataFrame) -> DataFrame:
    """Live transactions to start next: ``(predecessor_id, id, operation_id)``.

    Success starts all successors, an error those that run on a predecessor's error, anything else none.  Several
    results of one transaction in a batch are merged first, so each successor starts once and no group multiplies.
    """
    success = F.col("completed") & ~F.col("has_error")
    after = (
        results.where(success | F.col("has_error"))
        .groupBy(F.col("transaction_id").alias("predecessor_id"))
        .agg(F.bool_or(success).alias("_success"))
        .join(transactions.select(F.col("id").alias("predecessor_id")), "predecessor_id", "left_semi")
    )
    waiting = live_rows(transactions, "deleted").where(F.col("predecessor_id").isNotNull())
    return (
        waiting.join(after, "predecessor_id")
        .where(F.col("_success") | F.col("run_on_predecessor_error"))
        .select("predecessor_id", "id", "operation_id")
    )


def trigger_update(
    transactions: DataFrame, updates: DataFrame, operations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Triggered transactions with their operation details and new workflow identifier, and rejected updates.

    A null identifier keeps the old one.  Several updates of one transaction count as one, with the greatest
    identifier; an update without a known transaction is rejected.
    """
    new = updates.groupBy("id").agg(F.max("workflow_identifier").alias("_new"))
    known = transactions.withColumn("_known", F.lit(True))
    marked = cut_lineage(join_spread(new, known, "id"))
    accepted = marked.where("_known").withColumn("workflow_identifier", F.coalesce("_new", "workflow_identifier"))
    rejected = marked.where("_known IS NULL").select(
        "id", F.col("_new").alias("workflow_identifier"), F.lit("transaction not found").alias("reject_reason")
    )
    return transaction_detail(accepted.select(*transactions.columns), operations), rejected
