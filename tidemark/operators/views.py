"""Joined views of the identity, graph and workflow tables.

None of the joins carries a broadcast hint: Spark broadcasts a lookup side by its measured size and otherwise
shuffles, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keys import join_spread
from tidemark.operators.read import live_rows


def identity_view(identities: DataFrame, units: DataFrame) -> DataFrame:
    """Live identities with the display names of their manager and organisational unit.

    A deleted manager still lends its name.
    """
    managers = identities.select(
        F.col("id").alias("manager_id"), F.col("display_name").alias("manager_display_name")
    )
    unit_names = units.select(F.col("id").alias("unit_id"), F.col("display_name").alias("unit_display_name"))
    live = live_rows(identities, "deleted").drop("deleted")
    return join_spread(join_spread(live, unit_names, "unit_id"), managers, "manager_id")


def edge_view(edges: DataFrame, edge_types: DataFrame, nodes: DataFrame) -> DataFrame:
    """Live edges with their type and the details of both end nodes, deleted nodes included."""
    types = edge_types.select("edge_type_id", F.col("name").alias("edge_type_name"), "factor")

    def end(side: str) -> DataFrame:
        return nodes.select(
            F.col("identifier").alias(f"node_{side}"),
            F.col("display_name").alias(f"node_{side}_display_name"),
            F.col("type").alias(f"node_{side}_type"),
            F.col("c_factor").alias(f"node_{side}_c_factor"),
            F.col("a_factor").alias(f"node_{side}_a_factor"),
        )

    return (
        join_spread(live_rows(edges, "deleted").drop("deleted"), types, "edge_type_id")
        .join(end("to"), "node_to", "left")
        .join(end("from"), "node_from", "left")
    )


def approval_view(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Live approval requests with their state and a label ``approver - state``."""
    state_names = states.select("state_id", F.col("name").alias("state_name"))
    approver = F.coalesce("approver_display_name", "approver", F.lit(""))
    return (
        live_rows(requests, "deleted")
        .drop("deleted")
        .join(state_names, "state_id")
        .withColumn("label", F.concat(approver, F.lit(" - "), F.col("state_name")))
    )


def transaction_detail(transactions: DataFrame, operations: DataFrame) -> DataFrame:
    """Transactions with the details of their operation."""
    details = operations.select(
        F.col("id").alias("operation_id"),
        F.col("name").alias("operation_name"),
        F.col("uri").alias("operation_uri"),
        F.col("method").alias("operation_method"),
        "managed_identity",
        "retry",
    )
    return transactions.join(details, "operation_id")
