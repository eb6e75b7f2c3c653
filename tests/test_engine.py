"""Indexes in queries and measured executions."""

import pytest

from marlstone.operators import engine as E
from marlstone.operators.search import ROW_ID, row_ids
from marlstone.sources.records import from_json_array

RECORDS = '[{"a": "X", "n": 1, "t": ["p", "q"], "f": true}, {"a": "x", "n": 2.5, "t": "q"}, {"a": "y", "n": "1"}, {"a": null, "n": 1}, {"b": 1, "t": []}]'


@pytest.mark.parametrize("query", ['a = "x" STRICT', 'a IN ("X", "Y") STRICT', "n = 1 STRICT", 'n = "1" STRICT', 't = "q" STRICT', "f = true STRICT", 'a = "x" AND n = 1 STRICT', 'a = "none" STRICT', "a = null STRICT", 'a = "x" OR n = 1 STRICT', 'a != "x" STRICT', 'b = 1 AND a = "x" STRICT'])
def test_an_index_changes_no_result(spark, query):
    data = from_json_array(spark, RECORDS)
    engine = E.Engine(data, E.Options(("a", "n", "t", "f")))
    assert sorted(r[ROW_ID] for r in engine.query(query).collect()) == sorted(r[0] for r in row_ids(data, query).collect())
    engine.close()


def test_which_queries_an_index_narrows(spark, monkeypatch):
    engine = E.Engine(from_json_array(spark, RECORDS), E.Options(("a",)))
    narrowed = lambda q: engine._narrowed(engine.data.parse(q)) is not engine.data
    assert narrowed('a = "x" STRICT') and narrowed('n = 1 AND a = "x" STRICT')
    assert not any(map(narrowed, ('a = "x"', 'a = "x" STRICT CASE SENSITIVE', "n = 1 STRICT", 'a = "x" OR a = "y" STRICT', 'NOT a = "x" STRICT')))
    monkeypatch.setattr(E, "CANDIDATES", 1)
    assert not narrowed('a = "x" STRICT') and narrowed('a = "y" STRICT')
    engine.drop_index("a")
    assert not narrowed('a = "y" STRICT')


def test_metrics_are_of_executions(spark):
    engine = E.Engine(from_json_array(spark, RECORDS))
    engine.query("n = 1")
    assert engine.get_metrics()["query_count"] == 0
    engine.execute("n = 1")
    m = engine.get_metrics()
    assert m["query_count"] == 1 and m["rows_scanned"] == 5 and m["p95_latency_ms"] > 0
    assert E.Metrics().p95() == 0
    some = E.Metrics()
    for k in range(1, 201):
        some.record(float(k), 1)
    assert some.p95() == 190
    assert E.search_objects(spark, [{"a": 1}, {"a": 2}], "a = 2") == [{"a": 2}]


def test_columnar_data_is_held_and_let_go(spark):
    data = from_json_array(spark, RECORDS)
    engine = E.Engine(data, E.Options(columnar=True, columnar_fields=("a",)))
    assert engine.data.df.is_cached and not data.df.is_cached
    assert len(engine.execute('a = "x"')) == 2
    held = engine.data.df
    engine.update(from_json_array(spark, "[1]"))
    assert not held.is_cached and engine.execute("") == [1]
    engine.close()
    assert not engine.data.df.is_cached
