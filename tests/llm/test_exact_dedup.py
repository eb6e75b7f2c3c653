import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from marlstone.llm.exact_dedup import build_directory, build_index, exact_dedup


def brute(rows):
    same = defaultdict(list)
    for i, t in rows:
        same[t or ""].append(i)
    out = []
    for t, ids in same.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize(("capacity", "hot"), [(None, 1024), (2, 1024), (2, 2)])
def test_against_brute_force(docs_of, capacity, hot):
    """Windows of three rows: copies of a text are entries of many."""
    rows = [(k, ["a", "", None, "b" * 50_000, f"t{k}", "A", "a "][k % 7]) for k in range(60)] + [(None, "a"), (None, "only null"), (59, "t59"), (3, "b" * 50_000)]
    found = exact_dedup(docs_of([(i, t, "en", "s") for i, t in rows]), capacity=capacity, hot=hot, window_rows=3).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == brute(rows)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len({t or "" for _, t in rows})  # one row of each group, repeated rows too
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("hot", [1024, 2])
def test_lookup(docs_of, spark, hot):
    rows = [(k, ["a", "b" * 5000, f"t{k}", None][k % 4]) for k in range(80)]
    index = build_index(docs_of([(i, t, "en", "s") for i, t in rows]), capacity=4, hot=hot, window_rows=3)
    assert len(index.directory.buckets) > 1
    asked = spark.createDataFrame([("a",), ("t2",), ("none such",), ("",), ("b" * 5000,), ("a",), ("b" * 5001,)], "text string")
    found = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in index.lookup(asked).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {sha("a"): (76, 20), sha("t2"): (2, 1), sha(""): (79, 20), sha("b" * 5000): (77, 20)}
    assert index.lookup(asked.limit(0)).collect() == []


def test_one_huge_group(docs_of):
    """A third of all rows are one text; it reaches its owner from about sqrt(n) tasks, and one row of it stays."""
    rows = [(k, "same" if k % 3 == 0 else f"t{k}") for k in range(3000)]
    found = exact_dedup(docs_of([(i, t, "en", "s") for i, t in rows]), hot=10, window_rows=4).collect()
    same = [r for r in found if r["doc_id"] % 3 == 0]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(2997, 1000)} and [r["doc_id"] for r in same if r["kept"]] == [2997]
    assert len(found) == 3000 and sum(r["kept"] for r in found) == 2001


def test_a_very_long_text(docs_of):
    long = "x" * 20_000_000
    found = {r["doc_id"]: r for r in exact_dedup(docs_of([(1, long, "en", "s"), (2, long, "en", "s"), (3, long + "y", "en", "s")])).collect()}
    assert [found[k]["kept"] for k in (1, 2, 3)] == [False, True, True] and found[1]["text_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_empty(docs_of):
    assert exact_dedup(docs_of([])).collect() == []


@given(st.lists(st.integers(0, 255), max_size=60), st.integers(1, 5))
def test_directory(prefixes, capacity):
    counts = defaultdict(int)
    for p in prefixes:
        counts[p] += 1
    d = build_directory(counts, 8, capacity)
    assert len(d.slots) == 1 << d.depth
    for p in range(256):
        b = d.buckets[d.slots[p >> (8 - d.depth)]]
        assert b.prefix == p >> (8 - b.depth)
    for k, b in enumerate(d.buckets):
        own = sum(n for p, n in counts.items() if p >> (8 - b.depth) == b.prefix)
        assert own == b.entries and (own <= capacity or b.depth == 8)
        assert d.slots.count(k) == 1 << (d.depth - b.depth)
