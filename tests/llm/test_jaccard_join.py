import random
from collections import Counter

import pytest

from marlstone.llm import jaccard_join
from marlstone.llm.common import ascii_words
from marlstone.llm.jaccard_join import similarity_join


def brute(rows):
    """Links of each row and its component's least id, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = ascii_words((t or "").encode())
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    links, up = Counter(), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        t = top(k)
        ids[t] = min((x for x in (ids.get(t), i) if x is not None), default=None)
    return sorted(((i, links[k], ids[top(k)] if links[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, groups, size, others):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(40))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [shared + " " + " ".join(word() for _ in range(60)) for _ in range(others)]
    return rows


@pytest.mark.parametrize(("limit", "block", "size"), [(4096, 2048, 16 << 20), (8, 7, 16 << 20), (8, 2048, 1 << 12)])
def test_against_brute_force(docs_of, monkeypatch, limit, block, size):
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", size)
    texts = corpus(3, 6, 12, 40)
    rows = list(enumerate(texts)) + [(500, texts[0]), (501, texts[0].upper() + "!"), (502, ""), (503, None), (504, "..."), (505, "one two"), (506, "One, two"), (507, "two one"), (0, texts[0]), (None, texts[1]), (None, "q r s")]
    found = similarity_join(docs_of([(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in found), key=str) == brute(rows)
    first = Counter(r["class_id"] for r in found if r["first"] and r["n_links"])
    assert set(first.values()) == {1}
    assert all(r["first"] for r in found if not r["n_links"])


def test_empty(docs_of):
    assert similarity_join(docs_of([])).collect() == []


def test_rows_of_a_huge_group(spark):
    """100,000 members of one group: rows go with the number of blocks, each pair of blocks is one task, and no task has more than two blocks."""
    n, blocks = 100_000, -(-100_000 // jaccard_join.BLOCK)
    members = spark.range(n).selectExpr("id AS rep", "0L AS label", f"{blocks}L AS blocks", f"pmod(xxhash64(id), {blocks}L) AS block")
    tasks = jaccard_join.block_tasks(members)
    assert tasks.count() == n * blocks
    sizes = [r["count"] for r in tasks.groupBy("task").count().collect()]
    assert len(sizes) == blocks * (blocks + 1) // 2 and max(sizes) < 2.4 * jaccard_join.BLOCK


def test_a_very_long_text(docs_of):
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300_000))
    rows = [(1, long), (2, long + " and a few words more"), (3, long[: len(long) // 2])]
    found = {x["doc_id"]: x for x in similarity_join(docs_of([(i, t, "en", "s") for i, t in rows])).collect()}
    assert found[1]["class_id"] == found[2]["class_id"] == 1 and found[3]["class_id"] == 3 and found[2]["n_links"] == 1
