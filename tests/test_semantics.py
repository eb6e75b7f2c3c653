"""Queries over five JSON records whose results were traced by hand."""

import json

import pytest

from marlstone.operators import engine as E
from marlstone.operators.aggregate import SpecError, aggregate
from marlstone.operators.search import ROW_ID, row_ids, search
from marlstone.sources.records import from_json_array

RECORDS = """[
 {"name":"NetCore Router","country":"India","category":"network","price":500,"salary":2500000,"active":true,"tags":["router","fiber"],"meta":{"region":"APAC","owner":null},"notes":"crm rollout"},
 {"name":"Support Desk","country":"USA","category":"software","price":"750","salary":450000,"active":false,"tags":["support"],"meta":{"region":"AMER"},"notes":"Desk workflow"},
 {"name":"fibre switch","country":"india","category":"network","price":900.5,"salary":null,"active":true,"tags":[],"notes":null},
 {"name":"Billing","country":"UK","category":"finance","price":1000,"active":"true","tags":["billing",7],"meta":{"region":"APAC","owner":"Ana"}},
 {"name":"Ärger","country":null,"price":200}
]"""

FILTERS = {
    "": [0, 1, 2, 3, 4],
    'country = "India"': [0, 2],
    'country = "India" CASE SENSITIVE': [0],
    'country != "India"': [1, 3, 4],
    "country = India": [],
    "country != India": [0, 1, 2, 3, 4],
    "country IN (India, USA)": [0, 1, 2],
    'meta.region != "APAC"': [1],
    'NOT meta.region = "APAC"': [1, 2, 4],
    "price = 750": [1],
    "price = 750 STRICT": [],
    'price = "500"': [0],
    "price > 400": [0, 2, 3],
    "salary > price": [0, 1],
    "salary > price STRICT": [0],
    "price BETWEEN (200, 900)": [0, 4],
    "price BETWEEN 200 AND 900 AND active = true": [0],
    "price BETWEEN (price, 1000)": [0, 2, 3, 4],
    "active = true": [0, 2],
    'active = "true"': [3],
    "active IN (false)": [1],
    "active NOT IN (true)": [1, 3],
    'tags IN ("fiber","billing")': [0, 3],
    'tags NOT IN ("fiber")': [1, 2, 3],
    'tags != "router"': [0, 1, 3],
    "tags = 7": [3],
    'tags.0 = "router"': [0],
    'tags CONTAINS "fiber"': [0],
    'tags CONTAINS "fib"': [],
    'tags STARTS WITH "r"': [],
    "meta.owner EXISTS": [0, 3],
    "NOT notes EXISTS": [3, 4],
    "meta.owner IS NULL": [0, 1, 2, 4],
    "meta.owner IS NOT NULL": [3],
    "notes = null": [2],
    'name LIKE "%desk%"': [1],
    'name NOT LIKE "%desk%"': [0, 2, 3, 4],
    'notes NOT LIKE "%desk%"': [0],
    'name LIKE "ä%"': [],
    'name LIKE "Är%"': [4],
    'name STARTS WITH "net"': [0],
    'name ENDS WITH "desk"': [1],
    'name REGEX "^net.*"': [0],
    'name NOT REGEX "^net.*"': [1, 2, 3, 4],
    'name FUZZY "ruter"': [0, 4],
    'tags FUZZY "fibr"': [0],
    'name NOT FUZZY "desk"': [0, 2, 3, 4],
    'notes NOT FUZZY "crm"': [1, 2],
    "fiber": [0],
    "salary": [0, 1, 2],
    '"true"': [0, 2, 3],
    '"7"': [1, 3],
    "net*": [0, 2],
    "*flow": [1],
    "*ibr*": [2],
    "FUZZY biling": [3],
    'country = "UK" OR': [0, 1, 2, 3, 4],
    'country = "India" AND NOT tags IN ("fiber")': [2],
    "NOT NOT price > 400": [0, 2, 3],
    "NOT (price > 400 OR active = false)": [4],
}

ORDERS = {
    "ORDER BY salary": [1, 0, 3, 4, 2],
    "ORDER BY salary NULLS FIRST": [2, 1, 0, 3, 4],
    "ORDER BY salary DESC": [2, 3, 4, 0, 1],
    "ORDER BY salary DESC NULLS FIRST": [3, 4, 0, 1, 2],
    "ORDER BY price": [1, 4, 0, 2, 3],
    "ORDER BY price DESC LIMIT 2 OFFSET 1": [2, 0],
    "ORDER BY active": [3, 1, 0, 2, 4],
    "ORDER BY name": [3, 2, 0, 1, 4],
    "ORDER BY name CASE SENSITIVE": [3, 0, 1, 2, 4],
    "ORDER BY country": [0, 2, 3, 1, 4],
    'category IN ("network") ORDER BY price DESC': [2, 0],
    "LIMIT 2": [0, 1],
    "OFFSET 3": [3, 4],
}


@pytest.fixture(scope="module")
def data(spark):
    return from_json_array(spark, RECORDS)


@pytest.mark.parametrize("query", FILTERS)
def test_filter(data, query):
    assert sorted(r[0] for r in row_ids(data, query).collect()) == FILTERS[query]


@pytest.mark.parametrize("query", ORDERS)
def test_order(data, query):
    assert [r[0] for r in row_ids(data, query).collect()] == ORDERS[query]


def rows(data, query):
    return [json.loads(r["raw"]) for r in search(data, query).collect()]


def test_projection(data):
    assert rows(data, 'SELECT name, meta.region WHERE country = "UK"') == [{"meta": {"region": "APAC"}, "name": "Billing"}]
    assert rows(data, 'SELECT tags.0, meta.region WHERE category = "network"') == [{"meta": {"region": "APAC"}, "tags": {"0": "router"}}, {}]
    star = from_json_array(data.df.sparkSession, RECORDS, compat_star=True)
    assert rows(star, "SELECT * WHERE price = 200") == [{}]


def test_score(data):
    score = lambda q: [r["SCORE"] for r in rows(data, q)]
    assert score('SELECT name, SCORE WHERE tags IN ("fiber")') == [0.0]
    assert score('SELECT SCORE WHERE name CONTAINS "router"') == [pytest.approx(1.671149, abs=1e-6)]
    assert score('SELECT SCORE WHERE notes CONTAINS "crm" OR name CONTAINS "router"') == [pytest.approx(2.822035, abs=1e-6)]


def grouped(data, spec, **options):
    out = []
    for r in aggregate(data, spec, **options).collect():
        out.append({k: (json.loads(v.toJson()) if hasattr(v, "toJson") else v) for k, v in r.asDict().items()})
    return sorted(out, key=str)


def test_groups(data):
    found = grouped(data, '{"group_by":["category"],"aggs":[{"op":"COUNT","field":"*","alias":"n"}]}')
    assert {r["category"]: r["n"] for r in found} == {"network": 2, "software": 1, "finance": 1, None: 1}
    found = grouped(data, {"group_by": ["active"], "aggs": [{"op": "COUNT"}]})
    assert sorted((str(r["active"]), r["COUNT_*"]) for r in found) == [("False", 1), ("None", 1), ("True", 2), ("true", 1)]
    found = grouped(data, {"group_by": ["category"], "aggs": [{"op": "AVG", "field": "price"}]})
    assert {r["category"]: r["AVG_price"] for r in found} == {"network": 700.25, "software": None, "finance": 1000.0, None: 200.0}


def test_aggregates(data):
    one = lambda *aggs, **k: grouped(data, {"aggs": [dict(zip(("op", "field"), a, strict=False)) for a in aggs]} | k)
    assert one(("SUM", "price")) == [{"SUM_price": 2600.5}]
    assert one(("MIN", "salary"), ("MAX", "salary")) == [{"MIN_salary": 450000.0, "MAX_salary": 2500000.0}]
    assert one(("COUNT", "salary")) == [{"COUNT_salary": 3}]
    assert one(("COUNT", "meta.owner")) == [{"COUNT_meta.owner": 2}]
    assert one(("SUM", "name")) == [{"SUM_name": 0.0}]
    assert one(("COUNT",), filter="price > 100000") == []
    assert one(("COUNT",), filter="LIMIT 2") == [{"COUNT_*": 2}]
    assert one(("COUNT",), ("AVG", "price")) == [{"COUNT_*": 5, "AVG_price": 650.125}]
    shared = grouped(data, {"aggs": [{"op": "COUNT"}, {"op": "AVG", "field": "price"}]}, shared_state=True)
    assert shared == [{"COUNT_*": 9, "AVG_price": pytest.approx(288.944444, abs=1e-6)}]
    with pytest.raises(SpecError):
        aggregate(data, {"aggs": [{"op": "MEDIAN", "field": "price"}]})
    with pytest.raises(SpecError):
        aggregate(data, {"aggs": [{"op": "SUM"}]})


def test_distinct(data):
    values = lambda f: [json.loads(r[0].toJson()) for r in aggregate(data, {"distinct_fields": [f]}).collect()]
    assert values("country") == ["India", "USA", "india", "UK", None]
    assert values("meta.owner") == [None, "Ana"]


def test_engine(spark):
    registry = E.Registry(spark)
    h = registry.init_engine(RECORDS)
    assert h == 1
    engine = registry[h]
    total, page = engine.page('country = "India" LIMIT 1 OFFSET 1')
    assert total == 2 and [r[ROW_ID] for r in page.collect()] == [2]
    for _ in range(3):
        engine.query_json('country = "India"')
    assert engine.cache_stats()["entries"] >= 1 and engine.cache_stats()["hits"] >= 1
    assert engine.get_metrics()["query_count"] == 4
    found = {r["field"]: (r["keys"], r["entries"]) for r in engine.list_indexes().collect()}
    assert found["country"] == (3, 4) and found["active"] == (3, 4)
    assert engine.data_size()["row_count"] == 5
    engine.create_index("tags")
    engine.create_index("tags")
    assert {r["field"]: r["entries"] for r in engine.list_indexes().collect()}["tags"] == 5
    engine.drop_index("tags")
    registry.update_engine(h, "[1, \"a\"]")
    assert json.loads(registry[h].query_json("a")) == ["a"]
    registry.drop_engine(h)
    registry.drop_engine(h)
    with pytest.raises(E.HandleError):
        registry[h]
    assert json.loads(E.execute_query_json(spark, RECORDS, 'SELECT name WHERE price = 200')) == [{"name": "Ärger"}]
    assert json.loads(E.search_json(spark, json.loads(RECORDS), "price = 1000")[0])["name"] == "Billing"
