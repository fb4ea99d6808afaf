from tidemark.operators import quality, workflow
from tidemark.schemas import RELATIONSHIP_KEY


def test_first_failing_check_wins(spark, rows):
    requests = spark.createDataFrame(
        [
            (1, "op", None, None), (2, "nope", "nope", 99), (3, "op", "nope", 99), (4, "op", "ap", 99),
            (5, "op", "ap", 10), (6, None, None, None),
        ],
        "id int, operation_id string, approval_id string, predecessor_id int",
    )
    operations = spark.createDataFrame([("op",), ("op",)], "id string")
    approvals = spark.createDataFrame([("ap",)], "id string")
    transactions = spark.createDataFrame([(10,)], "id int")
    accepted, rejected = workflow.create_transactions(requests, operations, approvals, transactions)
    assert rows(accepted) == [(1, "op", None, None), (5, "op", "ap", 10)]
    assert rows(rejected, "id", "reject_reason") == [
        (2, "operation not found"),
        (3, "approval not found"),
        (4, "predecessor not found"),
        (6, "operation not found"),
    ]
    states = spark.createDataFrame([("s1", "New"), ("s2", "Done")], "state_id string, name string")
    opened = workflow.open_approvals(accepted, states, "me")
    assert rows(opened, "transaction_id", "approval_id", "state_id", "requester") == [(5, "ap", "s1", "me")]
    assert workflow.open_approvals(accepted, states.where("name = 'Done'"), "me").count() == 0


def chain(spark):
    return spark.sql(
        """SELECT * FROM VALUES (1, NULL, 'a', false, 'w1', NULL), (2, 1, 'a', true, NULL, NULL), (3, 1, 'b', false, NULL, NULL),
           (4, 1, 'b', true, NULL, timestamp_ntz'2024-01-01')
           AS t(id, predecessor_id, operation_id, run_on_predecessor_error, workflow_identifier, deleted)"""
    )


def test_successors_for_all_flag_pairs(spark, rows):
    for completed, has_error, want in [(True, False, [2, 3]), (True, True, [2]), (False, True, [2]), (False, False, [])]:
        results = spark.createDataFrame([(1, completed, has_error)], "transaction_id int, completed boolean, has_error boolean")
        assert [r[0] for r in rows(workflow.successors(results, chain(spark)), "id")] == want


def test_each_successor_starts_once(spark, rows):
    results = spark.createDataFrame(
        [(1, True, False), (1, True, False), (1, True, True)], "transaction_id int, completed boolean, has_error boolean"
    )
    assert rows(workflow.successors(results, chain(spark)), "id") == [(2,), (3,)]


def test_results_of_unknown_transactions(spark, rows):
    results = spark.createDataFrame([(1, True), (77, True)], "transaction_id int, completed boolean")
    recorded, rejected = workflow.record_results(results, chain(spark))
    assert rows(recorded) == [(1, True)]
    assert rows(rejected) == [(77, True, "transaction not found")]


def test_trigger_keeps_the_old_identifier_for_null(spark, rows):
    updates = spark.createDataFrame([(1, None), (2, "w2"), (99, "w")], "id int, workflow_identifier string")
    operations = spark.createDataFrame(
        [("a", "op a", "/a", "POST", True, 3)],
        "id string, name string, uri string, method string, managed_identity boolean, retry int",
    )
    updates = updates.union(spark.createDataFrame([(2, "w1"), (99, None)], updates.schema))
    out, rejected = workflow.trigger_update(chain(spark), updates, operations)
    assert rows(rejected) == [(99, "w", "transaction not found")]
    assert rows(out, "id", "workflow_identifier", "operation_name", "retry") == [(1, "w1", "op a", 3), (2, "w2", "op a", 3)]


def test_field_patterns(spark):
    df = spark.createDataFrame(
        [("12", "a@b.ch", "true", "x"), ("1a", "a@b", "2", None), (None, None, None, "y")],
        "n string, mail string, flag string, anything string",
    )
    got = quality.validate_fields(df, {"n": "digits", "mail": "email", "flag": "bit", "anything": "any"}).collect()
    assert {r["column"]: (r.rows, r.violations) for r in got} == {"n": (3, 1), "mail": (3, 1), "flag": (3, 1), "anything": (3, 0)}


def test_schema_rules(spark):
    df = spark.createDataFrame([("a",), ("abcd",), (None,)], "s string")
    got = {r.rule: r.violations for r in quality.check_schema(df, required=["s"], max_length={"s": 3}).collect()}
    assert got == {"required": 1, "max_length 3": 1}


def test_unique_relationships(spark, rows):
    data = [("s", "t", "o", "t", "r"), ("s", "t", "o", "t", "r"), ("s", "t", "o", None, "r"), ("s", "t", "o", None, "r"), ("x", "t", "o", "t", "r")]
    df = spark.createDataFrame(data, ", ".join(f"{k} string" for k in RELATIONSHIP_KEY))
    assert [r[-1] for r in rows(quality.check_unique(df, RELATIONSHIP_KEY))] == [2, 2]


def test_references(spark, rows):
    child = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(5,), (5,)], "key int")
    assert rows(quality.check_references(child, parent, {"ref": "key"})) == [(6, 2)]
