"""Typed tables: the same rows as JSON records give, plans that reach the scan, and laws of the language."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators.search import ROW_ID, Dataset, row_ids, search, total_and_page
from marlstone.sources.records import from_items, read_parquet

QUERIES = [
    'c_mktsegment = "building"', 'c_mktsegment != "BUILDING"', "c_acctbal > 100.5", "NOT c_acctbal > 100.5", "c_nationkey >= 7", "c_nationkey < 7.5", "c_nationkey = 7.5", "c_nationkey != 7.5", "NOT c_nationkey = 7",
    'c_nationkey = "7"', 'c_nationkey = "7" STRICT', "c_custkey BETWEEN 5 AND 60", "c_nationkey IN (1, \"2\", x)", "c_nationkey NOT IN (1, 2)", 'c_name LIKE "%00_1%"', 'c_name NOT LIKE "%1%"', 'c_name REGEX "1$"', 'c_name ENDS WITH "9"',
    'c_nationkey CONTAINS "7"', "c_missing = 1", "c_missing != 1", "NOT c_missing = 1", "c_missing IS NULL", "c_name EXISTS", "mach*", "*ing", "c_name", '"12"', "FUZZY bulding", 'c_mktsegment FUZZY "machinry"', 'c_mktsegment NOT FUZZY "machinry"',
    "c_custkey = c_nationkey", "c_custkey > c_nationkey", "(c_nationkey = 1 OR c_nationkey = 2) AND NOT c_acctbal < 0", "NOT (c_nationkey > 5 AND c_acctbal > 0)", "c_custkey > 3000000000", "c_nationkey < 3000000000",
]


@pytest.fixture(scope="module")
def customers(spark, sf):
    return Dataset(spark.read.parquet(f"{sf}/customer.parquet").withColumn(ROW_ID, F.col("c_custkey").cast("long")))


@pytest.fixture(scope="module")
def as_json(customers):
    rows = customers.df.orderBy(ROW_ID).drop(ROW_ID).toJSON().collect()
    first = json.loads(rows[0])["c_custkey"]
    return from_items(customers.df.sparkSession, rows), first


@pytest.mark.parametrize("query", QUERIES)
def test_typed_and_json_agree(customers, as_json, query):
    typed = sorted(r[0] for r in row_ids(customers, query).collect())
    records, first = as_json
    assert typed == sorted(r[0] + first for r in row_ids(records, query).collect())


@pytest.mark.parametrize("query", QUERIES[:24])
def test_complement(customers, query):
    n = customers.df.count()
    own, _, flags = query.partition(" STRICT")
    flags = " STRICT" if query.endswith("STRICT") else ""
    own = own.removesuffix(" STRICT")
    assert row_ids(customers, query).count() + row_ids(customers, f"NOT ({own}){flags}").count() == n
    assert row_ids(customers, f"NOT NOT ({own}){flags}").count() == row_ids(customers, query).count()


def test_pages_make_the_whole(customers):
    base = "c_acctbal > 0 ORDER BY c_mktsegment, c_acctbal DESC"
    whole = [r["c_custkey"] for r in search(customers, base).collect()]
    pages = [r["c_custkey"] for k in range(0, len(whole), 20) for r in search(customers, f"{base} LIMIT 20 OFFSET {k}").collect()]
    assert pages == whole
    everything, page = total_and_page(customers, base + " LIMIT 3")
    assert everything.count() == len(whole) and page.count() == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("table", "query", "pushed"),
    [
        ("lineitem", "l_quantity > 45", "GreaterThan(l_quantity,45.0)"),
        ("lineitem", "NOT l_quantity > 45", "Or(IsNull(l_quantity),LessThanOrEqual(l_quantity,45.0))"),
        ("orders", "o_orderkey = 7", "EqualTo(o_orderkey,7)"),
        ("orders", "o_orderkey > 7.5", "GreaterThan(o_orderkey,7)"),
        ("orders", 'o_orderstatus = "F"', "In(o_orderstatus, [F,f])"),
        ("customer", 'c_mktsegment = "BUILDING" CASE SENSITIVE', "EqualTo(c_mktsegment,BUILDING)"),
        ("lineitem", "l_discount BETWEEN 0.05 AND 0.07", "LessThanOrEqual(l_discount,0.07)"),
    ],
)
def test_filters_reach_the_scan(spark, sf, table, query, pushed):
    assert pushed in plan(search(read_parquet(spark, f"{sf}/{table}.parquet"), query))


def test_plans(spark, sf):
    orders, events = read_parquet(spark, f"{sf}/orders.parquet"), read_parquet(spark, f"{sf}/events.parquet", json_columns=("props",))
    assert "TakeOrderedAndProject" in plan(search(orders, "o_totalprice > 10 ORDER BY o_totalprice DESC LIMIT 20"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan(search(orders, "SELECT o_orderkey WHERE o_totalprice > 10"))
    for data, query in ((orders, 'o_orderpriority LIKE "1%" AND NOT o_orderstatus IN (F)'), (events, "props.k > 5 AND props.z IS NULL"), (orders, "high")):
        assert "Python" not in plan(search(data, query)) and "Arrow" not in plan(search(data, query))


def test_null_policies(spark):
    df = spark.createDataFrame([(0, 1, "a"), (1, None, None)], f"{ROW_ID} long, x int, s string")
    ids = lambda q, p: [r[0] for r in row_ids(Dataset(df, null_policy=p), q).collect()]
    assert ids("x != 2", "missing") == [0] and ids("x != 2", "json_null") == [0, 1]
    assert ids("s EXISTS", "missing") == [0] and ids("s EXISTS", "json_null") == [0, 1]
    assert ids("x IS NULL", "missing") == ids("x IS NULL", "json_null") == [1]
    assert ids("x = null", "missing") == [] and ids("x = null", "json_null") == [1]
    assert ids("NOT x > 0", "missing") == [1]
    assert ids("ORDER BY x", "missing") == [0, 1] and ids("ORDER BY x DESC", "missing") == [1, 0]


def test_nested_types(spark):
    df = spark.createDataFrame([(0, {"k": {"z": "Q"}}, [1, 5], [("u", 1.5)]), (1, {}, [], [])], f"{ROW_ID} long, m map<string,struct<z:string>>, a array<int>, l array<struct<n:string,v:double>>")
    ids = lambda q: [r[0] for r in row_ids(Dataset(df), q).collect()]
    assert ids('m.k.z = "q"') == [0] and ids("a > 4") == [0] and ids("a.1 = 5") == [0] and ids("l.0.v > 1") == [0] and ids("a BETWEEN 2 AND 9") == [0]
    assert ids("a NOT IN (1)") == [1] and ids("a != 1") == [0] and ids("a CONTAINS 5") == [0]
    (row,) = search(Dataset(df), "SELECT m.k.z, a.0, nothing LIMIT 1").collect()
    assert row.asDict(True) == {"m": {"k": {"z": "Q"}}, "a": {"0": 1}}


def test_folding_is_ascii_only(spark):
    rows = ["K", "k", "K", "İ", "i", "Ä%_.x", "ä%_.X", "a\nb", "A.B", "axb", "x\\Qy", "%", ""]
    df = spark.createDataFrame(list(enumerate(rows)), f"{ROW_ID} long, s string")
    found = lambda q: [rows[r[0]] for r in row_ids(Dataset(df), q).collect()]
    assert found('s CONTAINS "k"') == ["K", "k"] and found('s LIKE "i"') == ["i"] and found('s LIKE "%K"') == ["K", "k"]
    assert found('s STARTS WITH "ä%_.x"') == ["ä%_.X"] and found('s ENDS WITH ".X"') == ["Ä%_.x", "ä%_.X"]
    assert found('s LIKE "a_b"') == ["a\nb", "A.B", "axb"] and found('s LIKE "a%B"') == ["a\nb", "A.B", "axb"] and found('s CONTAINS "a.b"') == ["A.B"]
    assert found('s LIKE "%"') == rows and found('s LIKE ""') == [""] and found('s LIKE "%%"') == rows
    assert found("s CONTAINS 'Qy'") == ["x\\Qy"] and found("s LIKE '%.%' CASE SENSITIVE") == ["Ä%_.x", "ä%_.X", "A.B"]
