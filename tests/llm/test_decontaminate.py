import hashlib
import random
import re

from marlstone.llm.decontaminate import build_index, decontaminate, phrase_matches, search_index


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for name, text in items:
            own = words(text)
            n = min(10, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs_of):
    r = random.Random(5)
    vocabulary = ["the", "of", "Ärger", "x1", "to", "in", "a"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (10, "The, OF; to"), (11, ""), (12, None), (None, "a a a a"), (2, text(11)), (7, "not in any document")]
    docs = [(k, text(r.randint(0, 60))) for k in range(25)]
    docs += [(100, "zz " + items[0][1].upper() + " zz " + items[1][1]), (101, None), (102, ""), (103, "...!"), (100, items[1][1]), (104, "the of"), (None, "a a a a a")]
    table = docs_of([(i, t, "en", "s") for i, t in docs])
    bench = spark.createDataFrame(items, "item_id int, text string")
    for block in (32 << 20, 40):  # all items at once, and in blocks
        found = decontaminate(table, bench, block_bytes=block)
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()), key=str)
        assert got == brute(docs, items)


def test_proximity(spark, docs_of):
    bench = spark.createDataFrame([("q", "red fox jumps over")], "item_id string, text string")
    docs = docs_of([(1, "a red fox jumps over it", "en", "s"), (2, "the red quick fox jumps over", "en", "s"), (3, "over jumps the fox so red", "en", "s")])
    exact = {r["id"]: r["items"] for r in phrase_matches(docs, bench).collect()}
    near = {r["id"]: r["items"] for r in phrase_matches(docs, bench, slop=1).collect()}
    assert exact == {1: ["q"], 2: [], 3: []} and near == {1: ["q"], 2: ["q"], 3: []}


def test_empty(spark, docs_of):
    bench = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate(docs_of([]), bench).collect() == []
    (row,) = decontaminate(docs_of([(1, "a b", None, None)]), bench).collect()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)


def test_one_index_serves_many_benchmarks(spark, docs_of):
    docs = docs_of([(k, f"one two w{k} three four five", "en", "s") for k in range(50)])
    index = build_index(docs)
    for k in (3, 7):
        bench = spark.createDataFrame([("q", f"w{k} three four")], "item_id string, text string")
        assert [r["id"] for r in search_index(index, bench).collect() if r["items"]] == [k]
    terms = {t for r in index.collect() for t in r["terms"]}
    assert len(terms) == 5 + 50  # every word of every text has a list


def test_a_very_long_text_and_a_common_word(spark, docs_of):
    """A text longer than a shard, and a word that most of all texts is made of."""
    long = "the " * 1_200_000 + "a b c d e f g h i j k " + "the " * 1000
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "the " * 10)], "item_id int, text string")
    found = {r["doc_id"]: r for r in decontaminate(docs_of([(1, long, "en", "s"), (2, "the the", "en", "s")]), bench).collect()}
    assert (found[1]["n_words"], found[1]["n_hit"], found[1]["n_items"]) == (1_201_011, 1_201_011, 2) and found[2]["n_hit"] == 0
