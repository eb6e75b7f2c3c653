import random

from marlstone.llm.substring_dedup import remove_repeats, sentences, spans


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)).capitalize() + "."


def test_planted_passages(docs_of):
    r = random.Random(1)
    passages = [" ".join(sentence(r, n) for n in sizes) for sizes in ((9, 14, 20, 12), (30, 28), (55,), (5, 4, 6, 3, 20, 2, 2, 25))]
    docs, where = [], {}
    for k in range(40):
        own = [sentence(r, r.randint(1, 20)) for _ in range(12)]
        p = k % 5
        if p < 4:
            own[5:5] = [passages[p]]
            where.setdefault(p, []).append(k)
        docs.append((k, (" " if k % 2 else "\n").join(own)))
    clean = dict(docs)
    found = {x["doc_id"]: x for x in remove_repeats(docs_of([(i, t, "en", "s") for i, t in docs])).collect()}
    for k, t in docs:
        p = k % 5
        if p == 4 or where[p][0] == k:
            assert found[k]["text"] == clean[k] and found[k]["n_removed"] == 0
        else:
            assert found[k]["words_removed"] == len(passages[p].split())
            assert found[k]["text"].split() == t.replace(passages[p], "").split()


def test_within_a_document_and_edges(docs_of):
    r = random.Random(2)
    a, b = sentence(r, 30), sentence(r, 3)
    rows = [(1, f"{a} {b} {a}"), (2, None), (3, ""), (4, "\n\n"), (5, "short. one."), (6, "short. one."), (None, f"{a} {b}"), (7, a), (7, a)]
    found = {}
    for x in remove_repeats(docs_of([(i, t, "en", "s") for i, t in rows])).collect():
        found.setdefault(x["doc_id"], []).append(x)
    assert found[1][0]["text"] == f"{a} {b}"
    assert found[2][0]["text"] == "" and found[3][0]["n_sentences"] == 0
    assert found[5][0]["text"] == found[6][0]["text"] == "short. one."  # too short to count as a repeat
    assert found[None][0]["text"] == ""
    assert [x["text"] for x in found[7]] == ["", ""]
    assert remove_repeats(docs_of([])).collect() == []


def test_sentences_are_the_text():
    for t in ("A b. C d! E?\n\n F\nG", "", "x", "..", " a . b ", "一。 二"):
        assert "".join(sentences(t)) == t


def test_passages_without_sentence_marks_or_within_a_sentence(docs_of):
    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passage = words(60)
    docs = [(k, f"{words(15)} {passage} {words(11)} | {words(40)}", "en", "s") for k in range(8)]
    found = {x["doc_id"]: x for x in remove_repeats(docs_of(docs)).collect()}
    assert found[0]["n_removed"] == 0
    for k in range(1, 8):  # what is left of the passage are the words before its first clause and after its last
        left = set(found[k]["text"].split())
        assert 30 <= found[k]["words_removed"] <= 60 and left >= set(docs[k][1].split()) - set(passage.split())


def test_a_very_long_text(docs_of):
    r = random.Random(8)
    long = " ".join(sentence(r, r.randint(1, 30)) for _ in range(20_000))
    found = {x["doc_id"]: x for x in remove_repeats(docs_of([(1, long, "en", "s"), (2, "First one here. " + long + " Last one here.", "en", "s")])).collect()}
    assert found[1]["n_removed"] == 0 and found[1]["text"] == long
    assert found[2]["text"].split() == "First one here. Last one here.".split()


def test_spans_do_not_depend_on_place():
    r = random.Random(3)
    p = [sentence(r, 8) for _ in range(6)]
    one, two = (set(map(tuple, spans(x)[0].tolist())) for x in (p, [sentence(r, 9)] * 3 + p + [sentence(r, 7)]))
    assert len(one) == 5 and one <= two
