import math
from collections import defaultdict

import pytest

from marlstone.llm import mixing
from marlstone.llm.mixing import mix


def brute(rows, weights=(5.0, 2.0, 1.0)):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, full, target = 1.5 * sum(size.values()), set(), {s: 0.0 for s in order}
    while True:  # reshare until none is above
        open_ = [s for s in order if s not in full]
        if not open_:
            break
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * size[s]]
        if not over:
            for s in open_:
                target[s] = left * weight[s] / w
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            full.add(s)
    return size, target


ROWS = [(k, " ".join(["w"] * (k * 37 % 101)), ["big", "big", "b", "a", None, "", "big"][k % 7]) for k in range(400)] + [(None, "x y", "a"), (7, None, "z"), (8, "", "z"), (5, "one two three", "big"), (9, "w " * 5000, "c")]


@pytest.mark.parametrize("small", [False, True])
def test_targets_and_takes(docs_of, monkeypatch, small):
    if small:
        monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
        monkeypatch.setattr(mixing, "RANK_SLOTS", 7)
    docs = docs_of([(i, t, "en", s) for i, t, s in ROWS])
    taken, schedule = mix(docs)
    found = taken.collect()
    size, target = brute(ROWS)
    assert len(found) == len(ROWS)
    by = defaultdict(int)
    source = defaultdict(list)
    for i, t, s in ROWS:
        source[i, len((t or "").split())].append(s)
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        s = next(s for s in source[r["doc_id"], r["size"]] if size[s] == r["source_size"])
        assert r["target"] == pytest.approx(target[s])
        by[s] += r["taken"]
    for s in size:
        assert by[s] == math.floor(target[s] + 1e-9)
    slots = schedule.collect()
    assert sum(r["words"] for r in slots) == sum(by.values())
    assert len({r["slot"] for r in slots}) == len(slots)
    again = mix(docs_of([(i, t, "en", s) for i, t, s in reversed(ROWS)]))[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_schedule_is_even(docs_of):
    rows = [(k, "w " * 100, "ab"[k % 2]) for k in range(400)]
    slots = sorted(mix(docs_of([(i, t, "en", s) for i, t, s in rows]))[1].collect(), key=lambda r: r["slot"])
    share = sum(r["source"] == "a" for r in slots) / len(slots)
    for n in range(20, len(slots), 20):  # every prefix holds nearly the final shares
        assert abs(sum(r["source"] == "a" for r in slots[:n]) - share * n) < 4


def test_pieces_are_the_mix(docs_of):
    """The pieces of each slot are its block's words, whole and once, and what is taken of a document is the sum of its pieces."""
    docs = docs_of([(i, t, "en", s) for i, t, s in ROWS])
    found = mixing.scheduled_mix(docs, block_words=64)
    words, taken, ends = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in found.pieces.collect():
        assert 0 <= r["first_word"] < r["end_word"]
        words[r["slot"]] += r["end_word"] - r["first_word"]
        taken[r["doc_id"]] += r["end_word"] - r["first_word"]
        ends[r["slot"]] += [(r["place"], r["place"] + r["end_word"] - r["first_word"])]
    assert {r["slot"]: r["words"] for r in found.schedule.collect() if r["words"]} == words
    for runs in ends.values():
        runs.sort()
        assert all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))  # no gap, no overlap
    slots = defaultdict(set)
    for r in found.pieces.collect():
        slots[r["doc_id"]].add(r["slot"])
    by = defaultdict(list)
    for r in found.documents.collect():
        by[r["doc_id"]].append(r)
    for i, rows in by.items():
        assert sum(r["taken"] for r in rows) == taken[i]
        if len(rows) == 1:
            assert (rows[0]["first_slot"], rows[0]["last_slot"]) == ((min(slots[i]), max(slots[i])) if slots[i] else (None, None))


def test_a_very_long_text(docs_of):
    rows = [(1, "w " * 400_000, "a"), (2, "w " * 10, "b"), (3, None, "b")]
    found = {r["doc_id"]: r for r in mix(docs_of([(i, t, "en", s) for i, t, s in rows]))[0].collect()}
    assert found[1]["taken"] == 599_995 and found[2]["taken"] == 20 and found[3]["taken"] == 0


def test_empty(docs_of):
    assert mix(docs_of([]))[0].collect() == []
    (row,) = mix(docs_of([(1, None, None, None)]))[0].collect()
    assert (row["size"], row["target"], row["taken"]) == (0, 0.0, 0)


