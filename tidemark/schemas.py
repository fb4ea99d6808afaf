"""Schemas of the platform tables the operators read and write, as Spark DDL.

Every table also carries the standard columns: an integer row identity, who inserted and updated a row and when, the
deletion stamp (null while live) and a row version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STANDARD = (
    "row_identity bigint, inserted timestamp_ntz, inserted_by string, updated timestamp_ntz, updated_by string, "
    "deleted timestamp_ntz, row_version bigint"
)

TABLES = {
    "identity": "id string, name string, user_name string, display_name string, email string, given_name string, "
    "family_name string, middle_name string, title string, department string, division string, cost_center string, "
    "manager_id string, unit_id string, active boolean",
    "organizational_unit": "id string, name string, display_name string, parent_id string",
    "node": "id string, node_id string, identifier string, display_name string, table_name string, type string, "
    "c_factor bigint, c_factor_inherited bigint, a_factor bigint, a_factor_inherited bigint",
    "edge": "id string, node_to string, node_from string, table_name string, type string, edge_type_id string",
    "edge_type": "edge_type_id string, name string, display_name string, factor bigint",
    "relationship": "id string, subject_id string, subject_table_id string, object_id string, object_table_id string, "
    "relationship_type_id string, target_namespace_id string",
    "relationship_type": "id string, name string, display_name string",
    "shadow": "id string, table_id string, object_id string, shadow_json string",
    "transaction": "id string, predecessor_id string, operation_id string, approval_id string, request_id string, "
    "run_on_predecessor_error boolean, object_id_1 string, object_id_2 string, object_id_3 string, "
    "object_id_4 string, property_json_1 string, property_json_2 string, property_json_3 string, "
    "property_json_4 string, property_text_1 string, property_text_2 string, property_html_1 string, "
    "workflow_identifier string",
    "transaction_operation": "id string, name string, display_name string, uri string, method string, "
    "target_id string, managed_identity boolean, retry int, property_json_1 string, request boolean",
    "transaction_result": "id string, transaction_id string, completed boolean, has_error boolean, message string",
    "approval": "id string, name string, display_name string, approvals_required int",
    "approval_state": "state_id string, name string, display_name string",
    "approval_request": "id string, transaction_id string, state_id string, object_id string, object_table_id string, "
    "subject_id string, subject_table_id string, entitlement_id string, entitlement_table_id string, "
    "approver string, approver_display_name string, requester string, requester_display_name string, "
    "decided_by string, decided_at timestamp_ntz",
    "role": "id string, value string, display string, type string, enabled boolean, total_assignments_permitted int, "
    "role_type_id string",
    "role_type": "id string, name string, display_name string",
    "target": "id string, name string, display_name string, url string, target_type_id string, "
    "key_vault_name string, key_vault_secret_name string",
    "target_type": "id string, name string, display_name string",
    "target_namespace": "id string, name string, display_name string, identifier string, target_id string",
    "streamer": "id string, name string, description string, sql string, expires_at timestamp_ntz",
    "column": "id string, table_name string, column_name string, data_type string, max_length int, "
    "is_nullable boolean, display_name string",
    "messaging": "id string, name string, display_name string, description string",
    "messaging_message": "id string, messaging_id string, subject string, body string, body_html string, priority int",
    "messaging_message_recipient": "id string, messaging_message_id string, recipient string, "
    "recipient_display_name string, recipient_type string, delivered_at timestamp_ntz",
}

# The five columns that identify a relationship.
RELATIONSHIP_KEY = ["subject_id", "subject_table_id", "object_id", "object_table_id", "relationship_type_id"]


def schema(table: str) -> T.StructType:
    """Full schema of a platform table."""
    return T.StructType.fromDDL(f"{TABLES[table]}, {STANDARD}")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows with exactly the columns of a platform table, cast to its types; absent columns are null."""
    present = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(present[f.name]) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(table).fields
        ]
    )
