import gzip
import json

import pytest

from marlstone.operators.search import row_ids, search
from marlstone.plans.syntax import QueryError
from marlstone.sources import records as io
from marlstone.streaming.stream import stream_search


def test_gzip_codec():
    for text in ("", "abc", "ü" * 1000):
        assert io.gzip_decompress(io.gzip_compress(text)) == text
    assert gzip.decompress(io.gzip_compress_bytes(b"x")) == b"x"
    for bad in ("%%%", "AAAA"):
        with pytest.raises(io.SourceError):
            io.gzip_decompress(bad)


def test_arrays_keep_spelling_and_order(spark):
    data = io.from_json_array(spark, ' [ {"b": 1.0, "a": "x,]"} , 7, [1, {"c": null}], "s", null, true ]')
    assert [r["raw"] for r in data.df.orderBy("_row_id").collect()] == ['{"b": 1.0, "a": "x,]"}', "7", '[1, {"c": null}]', '"s"', "null", "true"]
    assert [r[0] for r in row_ids(data, '"1.0"').collect()] == [0]
    assert [r[0] for r in row_ids(data, '"7"').collect()] == [1]
    assert io._spellings(" [ ] ") == [] and io._spellings("[[],{}, -1.50 ]\n") == ["[]", "{}", "-1.50"]
    for bad in ("{}", "[", "nope", "", "[1 2]", "[1,]", "[1] x", "[1", "[,1]", "[1]]", "[nul]", "  "):
        with pytest.raises(io.SourceError):
            io.from_json_array(spark, bad)
    with pytest.raises(io.SourceError):
        io.from_bytes(spark, b"\xff")


def test_repeated_keys_take_the_last(spark):
    data = io.from_json_array(spark, '[{"a": 1, "a": 2}]')
    assert row_ids(data, "a = 2").count() == 1 and row_ids(data, "a = 1").count() == 0


def test_files(spark, tmp_path):
    items = [{"n": k, "s": f"v{k}"} for k in range(5)]
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(json.dumps(items).encode()))
    data = io.read_json_array(spark, f"file://{tmp_path}/a.json.gz")
    assert sorted(r[0] for r in row_ids(data, "n > 2").collect()) == [3, 4]
    (tmp_path / "b.json").write_text('[{"x": 1.0}, {"x": 1}]')
    spelled = io.read_json_array(spark, f"file://{tmp_path}/b.json")
    assert [r[0] for r in row_ids(spelled, '"1.0"').collect()] == [0] and row_ids(spelled, "x = 1").count() == 2
    assert io.from_gzip(spark, (tmp_path / "a.json.gz").read_bytes()).df.count() == 5
    io.write_json(data, search(data, "n > 2"), f"file://{tmp_path}/out", "gzip")
    again = io.read_json_lines(spark, f"file://{tmp_path}/out")
    assert json.loads(io.to_json_array(again, search(again, "ORDER BY n"))) == items[3:]


def test_parquet_keeps_variants(spark, sf, tmp_path):
    events = io.read_parquet(spark, f"{sf}/events.parquet", ("props",))
    kept = io.write_parquet(events, f"file://{tmp_path}/events")
    for text in ("props.k > 50", "props.k IN (1, 2)", "NOT props.zzz EXISTS", "*5*"):
        assert sorted(r["event_id"] for r in search(kept, text).collect()) == sorted(r["event_id"] for r in search(events, text).collect())
    again = io.read_parquet(spark, f"file://{tmp_path}/events")
    assert search(again, "props.k > 50").count() == search(events, "props.k > 50").count()
    records = io.write_parquet(io.from_json_array(spark, '[{"a": [1, {"b": "x"}]}, 7]'), f"file://{tmp_path}/records")
    assert [r[0] for r in row_ids(records, 'a.1.b = "x"').collect()] == [0] and records.record == "rec"


def test_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    data = io.Dataset(stream)
    text = 'SELECT o_orderkey WHERE o_orderstatus = "F" AND o_totalprice > 100000'
    q = stream_search(data, text).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == search(io.read_parquet(spark, f"{sf}/orders.parquet"), text).count()
    for refused in ("a ORDER BY b", "LIMIT 5", "SELECT SCORE"):
        with pytest.raises(QueryError):
            stream_search(data, refused)


def test_distance_is_the_unrestricted_one():
    import random

    import duckdb

    from marlstone.functions.fuzzy import distance

    r = random.Random(1)
    pairs = [tuple("".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(2)) for _ in range(500)] + [("ca", "abc")]
    con = duckdb.connect()
    for a, b in pairs:
        assert distance(a, b, 10) == con.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchall()[0][0]
