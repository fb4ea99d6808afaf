import datetime as dt
import random
import tempfile

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.directory_plan import plan_directory_changes
from tidemark.operators.merge import merge_upsert
from tidemark.operators.sync import full_sync
from tidemark.sources import directory, mapping, pages, tables
from tidemark.sources.state import commit_state, load_state


def test_read_table_formats(spark, rows):
    folder = tempfile.mkdtemp(prefix="tidemark-test-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    for fmt, options in [("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true", "inferSchema": "true"})]:
        df.write.format(fmt).option("header", "true").save(f"{folder}/{fmt}")
        out = tables.read_table(spark, f"{folder}/{fmt}", ["name"], ("gt", "id", 1), fmt=fmt, options=options)
        assert rows(out) == [("b",)]


def test_scan_entities_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Id int, Name int, other int")
    assert tables.scan_entities(df, ["NAME", "ID", "absent"]).columns == ["NAME", "ID"]


def test_delta_modes(spark, rows):
    df = spark.range(5)
    assert rows(tables.delta_read(df, "id", 3)) == [(4,)]
    assert rows(tables.delta_read(df, "id", 3, mode="ge")) == [(3,), (4,)]
    assert tables.delta_read(df, "id", None).count() == 5
    with pytest.raises(ValueError, match="mode"):
        tables.delta_read(df, "id", 3, mode="lt")


def test_delta_bound_reaches_the_scan(spark, plan_of):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert "GreaterThan(ts,2024-01-10T00:00)" in plan_of(tables.delta_read(events, "ts", "2024-01-10"))


def test_watermark_of_an_empty_read(spark):
    assert tables.next_watermark(spark.range(3), "id", 9).first()[0] == 2
    assert tables.next_watermark(spark.range(0), "id", 9).first()[0] == 9
    assert tables.next_watermark(spark.range(0), "id").first()[0] is None


def test_state_life_cycle(spark):
    path = tempfile.mkdtemp(prefix="tidemark-test-") + "/state"
    load = lambda source="dc1": load_state(spark, path, "users", source, "usn")
    assert load() is None
    commit_state(spark, path, "users", "dc1", "usn", "100", "2024-01-01")
    commit_state(spark, path, "other", "dc1", "usn", "7", "2024-01-05")
    assert load() == "100"
    commit_state(spark, path, "users", "dc1", "usn", "200", "2024-01-02", had_errors=True)
    commit_state(spark, path, "users", "dc1", "usn", None, "2024-01-02")
    assert load() == "100"
    assert load("dc2") is None  # another server's numbers mean nothing
    commit_state(spark, path, "users", "dc2", "usn", "5", "2024-01-03")
    assert load("dc2") == "5"
    assert load("dc1") is None


def test_mark_deleted_and_tombstones(spark, rows):
    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, None)], "id int, gone string")
    assert rows(tables.mark_deleted(df, "gone", ["yes"]), "id", "_state") == [
        (1, "Deleted"),
        (2, "Unclassified"),
        (3, "Unclassified"),
    ]
    both = tables.with_tombstones(df, spark.createDataFrame([(9,)], "id int"))
    assert rows(both.where("_state = 'Deleted'"), "id", "gone") == [(9, None)]


def test_map_properties(spark):
    df = spark.createDataFrame([("Ann", None, 3)], "first string, last string, n int")
    spec = {
        "full": ("template", "<%first%> <%last%>!"),
        "kind": ("lit", "user"),
        "n": None,
        "given": "first",
        "plain": ("template", "fixed"),
    }
    out = mapping.map_properties(df, spec)
    assert out.first().asDict() == {"full": "Ann !", "kind": "user", "n": 3, "given": "Ann", "plain": "fixed"}
    with pytest.raises(ValueError, match="mapping"):
        mapping.map_properties(df, {"x": ("sql", "1")})


def test_property_names_ignore_case(spark):
    df = spark.sql("SELECT map('DisplayName', 'a', 'mail', 'm', 'displayname', 'b') AS bag UNION ALL SELECT NULL")
    got = [r.bag for r in mapping.normalise_keys(df, "bag").collect()]
    assert {"displayname": "b", "mail": "m"} in got and None in got


def test_align_to_target(spark, caplog):
    df = spark.createDataFrame([("1", "x", True)], "ID string, name string, extra boolean")
    target = T.StructType.fromDDL("name string, id bigint, absent int")
    out = mapping.align_to_target(df, target, ["id"])
    assert out.schema.simpleString() == "struct<name:string,id:bigint>"
    assert "extra" in caplog.text
    with pytest.raises(ValueError, match="key columns missing: absent"):
        mapping.align_to_target(df, target, ["absent"])
    with pytest.raises(ValueError, match="no source column"):
        mapping.align_to_target(df, T.StructType.fromDDL("zzz int"), [])


def test_typed_properties(spark):
    body = '{"s":"x","i":5,"big":9223372036854775807,"d":1.5,"b":true,"n":null,"a":[1,"z"],"o":{"k":1}}'
    out = mapping.typed_properties(spark.createDataFrame([(1, body)], "id int, body string"), "body")
    got = {r.property: r for r in out.collect()}
    assert {k: r.kind for k, r in got.items()} == {
        "s": "string", "i": "long", "big": "long", "d": "decimal", "b": "boolean", "n": "null", "a": "raw", "o": "raw",
    }
    assert (got["s"].string_value, got["i"].long_value, got["big"].long_value) == ("x", 5, 2**63 - 1)
    assert (got["d"].decimal_text, got["d"].double_value, got["b"].boolean_value) == ("1.5", 1.5, True)
    assert (got["a"].string_value, got["o"].string_value) == ('[1,"z"]', '{"k":1}')


def test_pages(spark, rows):
    df = spark.createDataFrame([(1, '[{"id":"a"},{"id":"b","x":1}]'), (2, "[]"), (3, None)], "page int, value string")
    assert rows(pages.read_pages(df, item_schema="id string, x int")) == [(1, "a", None), (1, "b", 1)]
    with pytest.raises(ValueError, match="item_schema"):
        pages.read_pages(df)


def test_endpoints_may_differ(spark, rows):
    out = pages.union_endpoints({"a": spark.createDataFrame([(1, 2)], "id int, x int"), "b": spark.createDataFrame([(3,)], "id int")})
    assert rows(out, "endpoint", "id", "x") == [("a", 1, 2), ("b", 3, None)]


def test_relationships(spark, rows):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, m array<string>")
    assert rows(pages.expand_relationships(df, "m")) == [(1, "a"), (1, "b")]
    nested = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], "id int, member string")
    assert rows(pages.expand_relationships(df.select("id"), nested=nested, on=["id"])) == [(1, "x"), (1, "y")]


def test_decoding_follows_the_syntax(spark):
    schema = [
        ("flag", 1, "2.5.5.8"), ("num", 2, "2.5.5.9"), ("enum", 10, "2.5.5.9"), ("usn", 65, "2.5.5.16"),
        ("odd65", 65, "2.5.5.1"), ("when", 24, "2.5.5.11"), ("utc", 23, "2.5.5.11"), ("blob", 4, "2.5.5.10"),
        ("sid", 4, "2.5.5.17"), ("odd4", 4, "2.5.5.1"), ("acl", 66, "2.5.5.15"), ("dn", 64, "2.5.5.12"),
    ]
    values = [(1, name.upper(), 0, b"1") for name, *_ in schema] + [(1, "unknown", 0, b"1")]
    out = directory.decode_attributes(
        spark.createDataFrame(values, "dn int, attribute string, ordinal int, raw binary"),
        spark.createDataFrame(schema, "attribute string, om_syntax int, attribute_syntax string"),
    )
    kinds = {r.attribute.lower(): r.value.kind for r in out.collect()}
    assert kinds == {
        "flag": "boolean", "num": "integer", "enum": "integer", "usn": "long", "odd65": "text", "when": "time",
        "utc": "time", "blob": "bytes", "sid": "sid", "odd4": "text", "acl": "bytes", "dn": "text", "unknown": "text",
    }
    got = {r.attribute.lower(): r.value for r in out.collect()}
    assert got["flag"].boolean is False and got["num"].integer == 1 and got["usn"].long == 1
    assert got["when"].time is None and bytes(got["blob"].bytes) == b"1" and got["sid"].text == "MQ=="


def test_records_continue_in_slices(spark):
    values = [("a", "Member", i, f"m{i}") for i in range(7)] + [("a", "name", 0, "n"), ("a", "empty", None, None)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame(values, "dn string, attribute string, ordinal int, value string")
    got = {r.slice: r.attributes for r in directory.assemble_records(df, slice_size=3).collect()}
    assert got == {
        0: {"member": ["m0", "m1", "m2"], "name": ["n"], "empty": None},
        1: {"member": ["m3", "m4", "m5"]},
        2: {"member": ["m6"]},
    }


def test_ranges_keep_their_order_without_a_shuffle(spark, rows, plan_of):
    data = [
        ("g", "member;range=1500-*", [f"v{i}" for i in range(1500, 1700)]),
        ("g", "member;range=0-1499", [f"v{i}" for i in range(1500)]),
        ("h", "member", ["only"]),
        ("i", "member;range=0-*", []),
    ]
    out = directory.collect_ranges(spark.createDataFrame(data, "dn string, attribute string, values array<string>"))
    got = {r.ordinal: r.value for r in out.where("dn = 'g'").collect()}
    assert got == {i: f"v{i}" for i in range(1700)}
    assert rows(out.where("dn <> 'g'")) == [("h", "member", 0, "only")]
    assert "Exchange" not in plan_of(out)


def test_base_dn(spark, rows):
    names = ["OU=A,DC=x", "CN=1,OU=A,DC=x", "CN=2\\,b,OU=a,dc=X", "CN=3,OU=B,OU=A,DC=x", "CN=4,OU=BA,DC=x"]
    df = spark.createDataFrame([(n,) for n in names], "dn string")
    pick = lambda scope: rows(directory.under_base_dn(df, "ou=a,dc=x", scope=scope))
    assert pick("base") == [("OU=A,DC=x",)]
    assert pick("onelevel") == [("CN=1,OU=A,DC=x",), ("CN=2\\,b,OU=a,dc=X",)]
    assert len(pick("subtree")) == 4
    with pytest.raises(ValueError, match="scope"):
        pick("all")


DOCUMENT = (
    "<DS_REPL_ATTR_META_DATA><pszAttributeName>displayName</pszAttributeName><dwVersion>3</dwVersion>"
    "<ftimeLastOriginatingChange>133456789012345678</ftimeLastOriginatingChange>"
    "<uuidLastOriginatingDsaInvocationID>abc</uuidLastOriginatingDsaInvocationID>"
    "<usnOriginatingChange>12345</usnOriginatingChange><usnLocalChange>67890</usnLocalChange>"
    "<pszLastOriginatingDsaDN>CN=dc</pszLastOriginatingDsaDN></DS_REPL_ATTR_META_DATA>"
)


def test_replication_metadata(spark):
    blob = f"<?xml version='1.0'?><DS_REPL_ATTR_META_DATA_BLOB>{DOCUMENT}{DOCUMENT}</DS_REPL_ATTR_META_DATA_BLOB>"
    df = spark.createDataFrame([("one", DOCUMENT + "\x00"), ("two", blob), ("none", None)], "dn string, xml string")
    out = directory.parse_repl_metadata(df, "xml").collect()
    assert sorted(r.dn for r in out) == ["one", "two", "two"]
    assert all((r.attribute, r.version, r.usn_originating, r.usn_local) == ("displayName", 3, 12345, 67890) for r in out)
    assert out[0].changed.replace(tzinfo=None) == dt.datetime(2023, 11, 28, 21, 1, 41, 234567)


def test_value_metadata(spark):
    xml = (
        "<DS_REPL_VALUE_META_DATA><pszAttributeName>member</pszAttributeName><pszObjectDn>CN=u</pszObjectDn>"
        "<cbData>12</cbData><ftimeCreated>133456789012345678</ftimeCreated><ftimeDeleted>{}</ftimeDeleted>"
        "<ftimeLastOriginatingChange></ftimeLastOriginatingChange></DS_REPL_VALUE_META_DATA>"
    )
    df = spark.createDataFrame([(1, xml.format("0")), (2, xml.format("133456789012345678"))], "id int, xml string")
    got = {r.id: r for r in directory.parse_repl_metadata(df, "xml", values=True).collect()}
    assert (got[1].object_dn, got[1].data_size, got[1].is_deleted, got[1].deleted, got[1].changed) == ("CN=u", 12, False, None, None)
    assert got[2].is_deleted and got[2].created == got[2].deleted


def test_directory_plan(spark, rows):
    source = spark.createDataFrame(
        [
            ("new", "name", "N", "Created"), ("new", "member", "a", "Created"), ("old", "name", "O2", "Updated"),
            ("old", "mail", None, "Updated"), ("old", "title", "same", "Updated"), ("old", "member", "a", "Updated"),
            ("old", "member", "c", "Updated"), ("old", "member", "c", "Updated"), ("gone", "name", "x", "Deleted"),
        ],
        "dn string, attribute string, value string, _state string",
    )
    current = spark.createDataFrame(
        [
            ("old", "name", "O"), ("old", "mail", "o@x"), ("old", "title", "same"), ("old", "other", "kept"),
            ("old", "member", "a"), ("old", "member", "b"), ("orphan", "member", "z"), ("gone", "name", "y"),
        ],
        "dn string, attribute string, value string",
    )
    assert rows(plan_directory_changes(source, current, ["member"])) == [
        ("new", "add_object", "member", "a"),
        ("new", "add_object", "name", "N"),
        ("old", "add_value", "member", "c"),
        ("old", "delete_value", "member", "b"),
        ("old", "replace", "mail", None),
        ("old", "replace", "name", "O2"),
    ]


def test_directory_plan_with_one_huge_group(spark):
    """Half the values belong to one group; the plan is still exact."""
    members = lambda n, shift: spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("dn"),
        F.lit("member").alias("attribute"),
        (F.col("id") + shift).cast("string").alias("value"),
    )
    plan = plan_directory_changes(members(20000, 100), members(20000, 0), ["member"])
    got = {(r.dn, r.op): r["count"] for r in plan.groupBy("dn", "op").count().collect()}
    assert got[("hot", "add_value")] == 50 and got[("hot", "delete_value")] == 50


def test_directory_plan_shuffles_three_times(spark, plan_of):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    values = lines.select(F.col("l_orderkey").alias("dn"), F.lit("member").alias("attribute"), F.col("l_partkey").cast("string").alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(plan_directory_changes(values, values, ["member"]))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Members, flags of the objects, and both sides of the salted join.
    assert plan.count("Exchange hashpartitioning") <= 4 and "hashpartitioning(dn" in plan
    assert all("_salt" in part.split(")")[0] for part in plan.split("Join [dn")[1:])


@pytest.mark.parametrize(("number", "value"), [("1.12345678901234", 1.12345678901234), ("1e-12", 1e-12), ("1e30", 1e30)])
def test_decimals_are_not_cut(spark, number, value):
    row = mapping.typed_properties(spark.createDataFrame([(f'{{"d":{number}}}',)], "body string"), "body").first()
    assert row.kind == "decimal" and row.double_value == value and float(row.decimal_text) == value


def test_malformed_pages_are_not_lost(spark, rows):
    landed = [(1, '[{"id":1}]'), (2, '[{"id":2},{"id"'), (3, None), (4, "[]"), (5, '{"id":5}'), (6, "")]
    landed = spark.createDataFrame(landed, "page int, value string")
    with pytest.raises((PySparkException, Py4JError)):
        pages.read_pages(landed, item_schema="id int").collect()
    sound, rejected = pages.split_pages(landed)
    assert rows(pages.read_pages(sound, item_schema="id int")) == [(1, 1)]
    assert rows(rejected, "page") == [(2,), (5,), (6,)]


def test_a_full_sync_after_a_malformed_page_deletes_nothing(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    landed = spark.createDataFrame([('[{"id":1,"name":"a"}]',), ('[{"id":2,"na',)], "value string")
    with pytest.raises((PySparkException, Py4JError)):
        full_sync(target, pages.read_pages(landed, item_schema="id int, name string"), ["id"], percentage=50).collect()


def test_malformed_documents_fail(spark):
    bad = spark.createDataFrame([("<DS_REPL_ATTR_META_DATA><dwVersion>1</dwVer",)], "x string")
    with pytest.raises((PySparkException, Py4JError)):
        directory.parse_repl_metadata(bad, "x").collect()
    with pytest.raises((PySparkException, Py4JError)):
        mapping.typed_properties(spark.createDataFrame([('{"a":',)], "body string"), "body").collect()


def test_schema_rows_of_one_name_do_not_multiply(spark):
    values = spark.createDataFrame([("isOpen", bytearray(b"TRUE"))], "attribute string, raw binary")
    names = [("isopen", 1, "2.5.5.8"), ("ISOPEN", 1, "2.5.5.8")]
    out = directory.decode_attributes(values, spark.createDataFrame(names, "attribute string, om_syntax int, attribute_syntax string"))
    assert [r.value.boolean for r in out.collect()] == [True]


def test_slices_of_a_long_attribute_have_their_own_key(spark, rows):
    """A record that is too long for one row is merged by name and slice."""
    values = [("g", "member", i, f"m{i}") for i in range(5)] + [("h", "member", 0, "x")]
    records = directory.assemble_records(spark.createDataFrame(values, "dn string, attribute string, ordinal long, value string"), 2)
    merged = merge_upsert(records.limit(0), records, ["dn", "slice"])
    assert rows(merge_upsert(merged, records, ["dn", "slice"]), "dn", "slice") == [("g", 0), ("g", 1), ("g", 2), ("h", 0)]


def test_schema_names(spark):
    from tidemark.functions.types import extract_schema

    got = {f.name: f.dataType.simpleString() for f in extract_schema({"a": "decimal(10)", "b": "decimal", "c": "numeric(9,2)"})}
    assert got == {"a": "decimal(10,0)", "b": "decimal(18,0)", "c": "decimal(9,2)"}


def test_pages_are_sorted_out_by_the_schema_that_reads_them(spark, rows):
    landed = [(1, '[{"n":1}]'), (2, '[1,2]'), (3, '[{"n":"x"}]'), (4, '[{"n":2},{"n":true}]'), (5, "[]"), (6, None)]
    landed += [(7, '[{"other":1}]'), (8, '1],"w":[2'), (9, '[{"n":1}'), (10, '[{"n":null}]'), (11, '{"n":1}'), (12, "")]
    landed = spark.createDataFrame(landed, "page int, value string")
    sound, rejected = pages.split_pages(landed, item_schema="n int")
    assert rows(pages.read_pages(sound, item_schema="n int"), "page", "n") == [(1, 1), (10, None), (7, None)]
    reasons = {r.page: r.reject_reason for r in rejected.collect()}
    assert {p for p, r in reasons.items() if r == "page is not a JSON array"} == {8, 9, 11, 12}
    assert {p for p, r in reasons.items() if r == "a record does not fit the schema"} == {2, 3, 4}
    assert sound.count() == 5


def test_directory_plan_finds_names_in_any_case(spark, rows):
    source = [("CN=A,DC=x", "Mail", "new"), ("CN=A,DC=x", "Member", "u"), ("CN=B", "mail", "b"), (None, "mail", "z")]
    current = [("cn=a,dc=X", "mail", "old"), ("cn=a,dc=X", "MEMBER", "v"), ("cn=a,dc=X", "phone", "1")]
    schema = "dn string, attribute string, value string"
    plan = plan_directory_changes(spark.createDataFrame(source, schema), spark.createDataFrame(current, schema), ["member"])
    assert rows(plan) == [
        ("CN=A,DC=x", "add_value", "Member", "u"),
        ("CN=A,DC=x", "replace", "Mail", "new"),
        ("CN=B", "add_object", "mail", "b"),
        ("cn=a,dc=X", "delete_value", "MEMBER", "v"),
    ]
