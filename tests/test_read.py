import pytest
from pyspark.sql import functions as F

from tidemark.operators import read, views
from tidemark.schemas import TABLES, conform, schema


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "b", 5.0), (2, "a", None), (3, None, 5.0), (4, "a", 1.0), (5, "c", None)]
    return spark.createDataFrame(data, "id int, name string, score double")


def ids(df):
    return [r.id for r in df.collect()]


def test_null_sorts_lowest(people):
    assert ids(read.entity_read(people, order=["name", "id"])) == [3, 2, 4, 1, 5]
    assert ids(read.entity_read(people, order=[("name", "desc"), "id"])) == [5, 1, 2, 4, 3]
    assert ids(read.entity_read(people, select=["id"], order=[("score", "DESC"), ("id", "desc")])) == [3, 1, 4, 5, 2]


def test_top_and_skip(people):
    assert ids(read.entity_read(people, order=["id"], top=2, skip=1)) == [2, 3]
    assert ids(read.entity_read(people, order=["id"], top=0)) == [1, 2, 3, 4, 5]
    assert ids(read.entity_read(people, order=["id"], top=-1)) == [1, 2, 3, 4, 5]
    assert ids(read.entity_read(people, order=["id"], skip=9)) == []


def test_distinct_applies_to_the_projection(people, rows):
    assert rows(read.entity_read(people, select=["name"], distinct=True)) == [("a",), ("b",), ("c",), (None,)]


def test_sort_by_a_column_that_is_not_selected(people):
    out = read.entity_read(people, select=["id"], order=["name", "id"], top=1)
    assert out.columns == ["id"] and ids(out) == [3]


def test_pages_by_key_cover_the_table(people):
    seen, after = [], None
    while True:
        page = ids(read.page_after(people.drop("name", "score"), [("id", "desc")], after, top=2))
        if not page:
            break
        seen += page
        after = [page[-1]]
    assert seen == [5, 4, 3, 2, 1]


def test_page_by_two_keys(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(3)], "g string, i int")
    out = read.page_after(df, [("g", "desc"), "i"], ["b", 1], top=2).collect()
    assert [tuple(r) for r in out] == [("b", 2), ("a", 0)]


def test_next_page(people):
    assert tuple(read.next_page(people, top=5, skip=10).first()) == (5, 15)
    assert tuple(read.next_page(people, top=6).first()) == (5, None)


def test_counts_and_live_rows(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, NULL), (2, timestamp_ntz'9999-12-31'), (3, timestamp_ntz'2024-01-01') AS t(id, deleted)"
    )
    assert read.entity_count(df, deleted_col="deleted").first()[0] == 1
    assert read.entity_count(df, deleted_col="deleted", include_deleted=True).first()[0] == 3
    assert read.entity_count(df, where=("gt", "id", 1)).first()[0] == 2
    assert sorted(ids(read.live_rows(df, "deleted", sentinel="9999-12-31"))) == [1, 2]


def test_search_and_optional_filters(people):
    assert sorted(ids(read.search_any(people, ["name"], "a"))) == [2, 4]
    assert len(ids(read.search_any(people, ["name"], None))) == 5
    assert ids(read.optional_filters(people, {"name": "a", "id": 4, "score": None})) == [4]
    assert ids(read.find_by_id(people, "id", 3)) == [3]


def test_minimal_view_falls_back_to_name(people, spark):
    assert read.minimal_view(people, "id").columns == ["id", "display_name"]
    assert read.minimal_view(people.drop("name"), "id").columns == ["id"]
    both = spark.createDataFrame([(1, "n", "d")], "id int, name string, display_name string")
    assert tuple(read.minimal_view(both, "id").first()) == (1, "d")


def test_identity_view_names_deleted_managers(spark, rows):
    identities = spark.sql(
        """SELECT * FROM VALUES (1, 'boss', NULL, 9, timestamp_ntz'2024-01-01'), (2, 'dev', 1, 9, NULL),
           (3, 'lone', NULL, NULL, NULL) AS t(id, display_name, manager_id, unit_id, deleted)"""
    )
    units = spark.createDataFrame([(9, "Unit")], "id int, display_name string")
    out = views.identity_view(identities, units)
    got = rows(out, "id", "display_name", "manager_display_name", "unit_display_name")
    assert got == [(2, "dev", "boss", "Unit"), (3, "lone", None, None)]


def test_approval_label(spark, rows):
    requests = spark.sql(
        """SELECT * FROM VALUES (1, 's', NULL, NULL, NULL), (2, 's', 'jd', NULL, NULL), (3, 's', 'jd', 'Jane', NULL),
           (4, 'gone', 'x', 'X', NULL), (5, 's', 'x', 'X', timestamp_ntz'2024-01-01')
           AS t(id, state_id, approver, approver_display_name, deleted)"""
    )
    states = spark.createDataFrame([("s", "New")], "state_id string, name string")
    assert rows(views.approval_view(requests, states), "id", "label") == [
        (1, " - New"),
        (2, "jd - New"),
        (3, "Jane - New"),
    ]


def test_filter_and_projection_reach_the_scan(spark, plan_of):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = plan_of(
        read.entity_read(orders, ["o_orderkey"], ("and", ("eq", "o_orderstatus", "F"), ("ge", "o_orderdate", "2000-01-01")))
    )
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(o_orderdate,2000-01-01" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan
    top = plan_of(read.entity_read(orders, ["o_orderkey"], order=["o_totalprice"], top=5, skip=5))
    assert "TakeOrderedAndProject" in top
    live = plan_of(read.live_rows(orders, "o_orderdate", sentinel="9999-12-31"))
    assert "PushedFilters: [Or(IsNull(o_orderdate),EqualTo(o_orderdate" in live


def test_platform_schemas(spark):
    for table in TABLES:
        fields = [f.name for f in schema(table).fields]
        assert len(fields) == len(set(fields)) and "deleted" in fields
    df = conform(spark.range(1).selectExpr("cast(id as string) AS ID", "5 AS factor_x"), "node")
    assert df.schema.simpleString() == schema("node").simpleString() and df.first()["id"] == "0"


@pytest.mark.parametrize("order", [["kind", ("id", "desc")], [("kind", "desc"), "id"]])
def test_skip_without_top_keeps_the_order(spark, order):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 2, "hot").when(F.col("id") % 10 > 0, "a").alias("kind"))
    df = df.repartition(7)
    want = [tuple(r) for r in df.orderBy(*read.sort_keys(order)).collect()][123:]
    assert [tuple(r) for r in read.entity_read(df, order=order, skip=123).collect()] == want
    assert [r.id for r in read.entity_read(df, ["id"], order=order, skip=990).collect()] == [r[0] for r in want[-10:]]


def test_skip_without_order_or_beyond_the_end(spark):
    df = spark.range(100)
    assert read.entity_read(df, skip=30).count() == 70 and read.entity_read(df, order=["id"], skip=100).count() == 0
    ties = df.select(F.lit(1).alias("x"))
    assert read.entity_read(ties, order=["x"], skip=40).count() == 60


def test_skip_without_top_gathers_no_rows_in_one_task(spark, plan_of):
    plan = plan_of(read.entity_read(spark.range(100), order=["id"], skip=3))
    assert "CollectLimit" not in plan and "GlobalLimit" not in plan
