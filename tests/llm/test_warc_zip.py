import base64
import hashlib
import io
import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import warc_zip
from marlstone.llm.warc_zip import PackageReader, PackageWriter, parse_record, read_packages, round_trip, warc_record, write_packages


@pytest.mark.parametrize("zip64", [False, True])
def test_package(zip64):
    out = io.BytesIO()
    w = PackageWriter(out, zip64)
    members = {"a/b.bin": b"\x00" * 1000, "ä.txt": b"", "c": b"PK\x05\x06 inside"}
    for k, v in members.items():
        w.add(k, v)
    w.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:  # an independent reader agrees
        assert z.testzip() is None and {i.filename: z.read(i) for i in z.infolist()} == members
    r = PackageReader(io.BytesIO(data), len(data))
    assert {k: r.range(*r.data_at(k)) for k in r.members} == members


def test_packages_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", b"abc", zipfile.ZIP_STORED)
        z.writestr("packed", b"abc" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = out.getvalue()
    r = PackageReader(io.BytesIO(data), len(data))
    assert r.range(*r.data_at("stored")) == b"abc"
    with pytest.raises(ValueError, match="compressed"):
        r.data_at("packed")
    with pytest.raises(ValueError, match="not a ZIP"):
        PackageReader(io.BytesIO(b"nothing"), 7)


@given(st.binary(max_size=300))
def test_record(payload):
    head, body = parse_record(warc_record("response", "urn:page:1", "http://x", payload, "D", None))
    assert body == payload and head["WARC-Record-ID"] == "<urn:page:1>" and head["Content-Length"] == str(len(payload))


def brute(pages, least=0):
    out = []
    for i, h in pages:
        h = (h or "").encode()
        same = [j for j, g in pages if (g or "").encode() == h and j is not None]
        first = min(same, default=None) if len(h) >= least else i
        revisit = first is not None and first != i
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, least):
    pages = [(k, ["<p>ä</p>", "", None, "x" * 100_000, f"<b>{k}</b>", "ab", "WARC/1.0\r\n\r\n"][k % 7]) for k in range(50)] + [(None, "ab"), (None, "only"), (5, "ab"), (3, "x" * 100_000)]
    df = spark.createDataFrame([(i, None if i == 4 else f"http://x/{i}\n", h, "d") for i, h in pages], "page_id long, url string, html string, digest string")
    found = [tuple(r) for r in round_trip(df, revisit_bytes=least).collect()]
    assert sorted(found, key=str) == brute(pages, least)
    assert round_trip(df.limit(0)).collect() == []


def test_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, "v", "<p>é</p>"), (3, "w", "z")], "page_id long, url string, html string")
    paths = write_packages(df, f"file://{tmp_path}/w", zip64=True)
    written = spark.createDataFrame(paths.collect(), "path string, n_records long")
    found = {r["urn"]: r for r in read_packages(written).collect()}
    assert bytes(found["urn:page:1"]["payload"]).decode() == "<p>é</p>" and found["urn:page:2"]["payload"] == b"" and found["urn:page:2"]["refers_to"] == "urn:page:1"


def test_equal_digests_of_unequal_payloads(spark, monkeypatch):
    """SHA-1 has known collisions; here all payloads have one digest."""
    monkeypatch.setattr(warc_zip.F, "sha1", lambda c: F.lit("same"))
    df = spark.createDataFrame([(1, "u", "one"), (2, "v", "two"), (3, "w", "one"), (4, "x", "six")], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in round_trip(df).collect()} == {1: None, 2: None, 3: 1, 4: None}


def test_ids_of_any_text(spark):
    ids = ["null", None, "a b", "line\nbreak", "é/%2F+?", "", "urn:no-page", " x "]
    df = spark.createDataFrame([(i, "http://x", f"<p>{k // 2}</p>") for k, i in enumerate(ids)], "page_id string, url string, html string")
    found = [(r["page_id"], r["refers_to"]) for r in round_trip(df).collect()]
    assert sorted(i or "" for i, _ in found) == sorted(i or "" for i in ids) and [i for i, _ in found].count(None) == 1
    assert sorted(t for _, t in found if t is not None) == sorted(["null", "a b", "", " x "])


def test_index_lines(spark, tmp_path):
    urls = ["https://www.Example.com/b?q=1", "http://a.example.org:8080", None, "no address", "http://[bad"]
    assert [warc_zip.surt(u) for u in urls] == ["com,example)/b?q=1", "org,example,a:8080)/", "-)/", "-)/noaddress", "-)/"]
    df = spark.createDataFrame([(k, u, f"p{k}") for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    (path,) = [r["path"] for r in write_packages(df, f"file://{tmp_path}/w").collect()]
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        lines = z.read("indexes/00000.cdxj").decode().splitlines()
        assert lines == sorted(lines) and lines[-1].startswith("org,example,a:8080)/ 20240101000000 {")
        warc = z.read("archive/00000.warc.gz")
        for line in lines:
            e = json.loads(line.split(" ", 2)[2])
            head, body = parse_record(warc[e["offset"] : e["offset"] + e["length"]])
            assert head["WARC-Payload-Digest"] == e["digest"] and body.startswith(b"p")


def test_adjacent_ranges_are_read_at_once(monkeypatch):
    reads = []

    class Package:
        def range(self, at, length):
            reads.append((at, length))
            return bytes(k % 251 for k in range(at, at + length))

    monkeypatch.setattr(warc_zip, "READ_AHEAD", 100)
    ranges = [(40, 10), (0, 40), (50, 60), (200, 5), (110, 300)]
    assert [len(x) for x in warc_zip._ranges(Package(), ranges)] == [40, 10, 60, 300, 5]
    assert reads == [(0, 50), (50, 60), (110, 300), (200, 5)]


def test_clashing_columns_and_a_very_long_payload(spark):
    names = "page_id long, url string, html string, key string, digest string, first long, path string, urn string, n long, record_type string"
    long = "é<p>" * 3_000_000
    df = spark.createDataFrame([(k, "u", t, "k", "d", 9, "p", "urn:page:5", 3, "x") for k, t in enumerate((long, long, "b"))], names)
    found = {r["page_id"]: r for r in round_trip(df).collect()}
    assert found[0]["payload_bytes"] == len(long.encode()) and [found[k]["refers_to"] for k in range(3)] == [None, 0, None]
