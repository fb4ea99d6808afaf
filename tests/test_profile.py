import pytest

from tidemark.operators import profile


def infer(spark, values, schema, **options):
    df = spark.createDataFrame([(v,) for v in values], f"p {schema}")
    return profile.infer_columns(profile.profile_properties(df, **options)).first()


def bag(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "b string")
    return {r.property: r for r in profile.infer_columns(profile.profile_bag(df, "b")).collect()}


@pytest.mark.parametrize(
    ("values", "schema", "expected"),
    [
        ([25, 30], "int", "INT"),
        ([1, 200], "smallint", "INT"),
        ([-5, 120], "tinyint", "INT"),
        ([1, 2**63 - 1], "bigint", "BIGINT"),
        ([-(2**63), 0], "bigint", "BIGINT"),
        ([-(2**31), 2**31 - 1], "bigint", "INT"),
        ([2**31], "bigint", "BIGINT"),
        ([True, False], "boolean", "BIT"),
        ([1.5], "double", "FLOAT"),
        (["John Doe", "Jane Smith"], "string", "VARCHAR"),
        (["Hello üöä"], "string", "NVARCHAR"),
        ([b"abc"], "binary", "VARBINARY"),
        ([["ü"]], "array<string>", "VARCHAR"),  # other types are profiled as text without the flag
        ([None], "int", "VARCHAR"),
    ],
)
def test_types(spark, values, schema, expected):
    assert infer(spark, values, schema).sql_type == expected


def test_datetime_and_guid(spark):
    row = profile.infer_columns(profile.profile_properties(spark.sql("SELECT timestamp'2024-01-01' AS p"))).first()
    assert row.definition == "[p] DATETIME2(7) NOT NULL"
    assert infer(spark, ["a1b2c3d4-e5f6-7890-abcd-ef1234567890"], "string", guid_columns=["p"]).sql_type == "UNIQUEIDENTIFIER"


def test_nulls_and_lengths(spark):
    row = infer(spark, [None, None], "string")
    assert (row.nulls, row.observations, row.is_nullable, row.definition) == (2, 2, True, "[p] VARCHAR(MAX) NULL")
    assert infer(spark, ["Short", "A much longer string value"], "string").max_length == 26
    assert infer(spark, ["a😀"], "string").max_length == 3
    assert infer(spark, ["x" * 100], "string").definition == "[p] VARCHAR(128) NOT NULL"
    assert infer(spark, ["x" * 4000], "string").definition == "[p] VARCHAR(MAX) NOT NULL"
    assert infer(spark, [b"x" * 20], "binary").definition == "[p] VARBINARY(32) NOT NULL"


def test_an_absent_property_is_not_a_null(spark):
    got = bag(spark, '{"DisplayName":"John"}', '{"DisplayName":"Jane","Email":"jane@example.com"}', '{"Age":null}')
    assert got["email"].definition == "[email] VARCHAR(32) NOT NULL" and got["email"].observations == 1
    assert got["displayname"].observations == 2
    assert got["age"].definition == "[age] VARCHAR(MAX) NULL"


def test_mixed_types(spark):
    got = bag(
        spark,
        '{"a":1,"b":true,"c":1,"d":1.5,"e":true,"f":"x","g":[1,2],"h":3000000000,"i":"ü"}',
        '{"a":true,"b":false,"c":2.5,"d":true,"e":"x","f":2,"g":{"k":1},"h":1,"i":1}',
    )
    types = {k: r.sql_type for k, r in got.items()}
    assert types == {
        "a": "INT", "b": "BIT", "c": "FLOAT", "d": "FLOAT", "e": "VARCHAR", "f": "VARCHAR", "g": "VARCHAR",
        "h": "BIGINT", "i": "NVARCHAR",
    }
    assert got["g"].max_length == 7


def test_by_entity_type(spark):
    df = spark.createDataFrame([("user", 1, "a"), ("user", 2, None), (None, 3, "b")], "kind string, n int, s string")
    found = profile.profile_properties(df, by="kind")
    got = {(r.entity_type, r.property): (r.observations, r.nulls) for r in found.collect()}
    assert got == {("user", "n"): (2, 0), ("user", "s"): (2, 1), ("Default", "n"): (1, 0), ("Default", "s"): (1, 0)}
    counts = {r.entity_type: (r.entities, r.properties) for r in profile.entity_types(df, "kind", found).collect()}
    assert counts == {"user": (2, 2), "Default": (1, 2)}


def test_no_entities(spark):
    empty = spark.createDataFrame([], "kind string, n int")
    assert profile.profile_properties(empty, by="kind").count() == 0


def test_profile_is_one_partial_and_final_aggregate(spark, plan_of):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = plan_of(profile.profile_properties(documents, by="lang"))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan and "Object" not in plan
