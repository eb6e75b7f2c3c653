import math
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import lm


def brute(rows):
    train = [(t or "") for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    fold = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    c = Counter(w for t in train for w in fold(t))
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    return n, sorted(((i, len(fold(t)), sum(c[w] > 0 for w in fold(t)), round(sum(map(base, fold(t))), 6)) for i, t in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"head_words": 3}, {"group_bytes": 8, "head_words": 10}])
def test_base_score_and_folds(docs_of, options):
    rows = [(k, f"The cat {'sat' if k % 3 else 'SAT'} on w{k % 11} the mat w{k}", "en", "s") for k in range(60)] + [(100, None, "en", "s"), (101, "", "en", "s"), (None, "the cat", "en", "s"), (5, "the " * 300, "en", "s"), (5, "the", "en", "s")]
    found = lm.score(docs_of(rows), **options).collect()
    n, wanted = brute([(r[0], r[1]) for r in rows])
    assert {r["train_tokens"] for r in found} == {n}
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found), key=str) == wanted
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 1) for r in found)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_groups_agree(docs_of):
    """The words of a filter that goes out in groups score as those of one."""
    rows = [(k, f"alpha beta gamma{k % 5} delta{k % 7} alpha beta", "en", "s") for k in range(80)]
    one, many = ({r["doc_id"]: r["score"] for r in lm.score(docs_of(rows), group_bytes=b).collect()} for b in (1 << 20, 8))
    assert all(abs(one[k] - many[k]) < 1e-6 for k in one)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    from marlstone.llm.queries import op9_lm_score

    found = [r for r in op9_lm_score(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_filter():
    some = lambda seed, n: np.random.default_rng(seed).integers(1 << 43, 3 << 42, n, dtype=np.uint64)  # noqa: E731  part 2 of 4, of 44 bits
    keys = some(1, 5000)
    counts = np.random.default_rng(2).integers(1, 500, 5000)
    level = lm.levels(counts)
    f = lm.Filter(4, 44, {2: lm.build(keys, level, 2, 4, 44)})
    got = f.level(keys, 2)
    assert (got >= level).all()  # a Bloom filter never forgets
    assert (got == level).mean() > 0.9
    unseen = some(3, 5000)
    assert (f.level(some(4, 1_000_000), 2) > 0).mean() < 4e-5
    assert (f.level(unseen, 2) > 0).mean() < 0.001 and not f.level(keys, 1).any()


def test_levels():
    assert lm.levels(np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12])).tolist() == [0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 7]
    for c in range(1, 5000):
        k = lm.levels(np.array([c]))[0]
        assert lm._LEAST[k] <= c <= lm._MOST[k]


def brute_scores(rows):
    """The model of the docstring from exact counts: a function from (u, v, w) to a probability, and each row's score."""
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    text = lambda t: ["<s>", "<s>", *(w.decode() for w in (t or "").encode().lower().split()), "</s>"]
    c1, c2, c3, n_texts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if crc(i) % 5 != 1:
            w = text(t)
            n_texts += 1
            c1.update(w[2:])
            c2.update(zip(w[1:], w[2:], strict=False))
            c3.update(zip(w, w[1:], w[2:], strict=False))
    space = sum(c1.values()) + 0.5 * (len(c1) + 1)
    ends = [1.5**k for k in range(60)]
    low = lambda c: max((math.ceil(e - 1e-9) for e in ends if math.ceil(e - 1e-9) <= c), default=0)
    high = lambda c: min(math.ceil(e - 1e-9) - 1 for e in ends[1:] if math.ceil(e - 1e-9) > c) if c else 0

    def smoothing(grams, contexts, kinds):
        n = [sum(v == k for v in grams.values()) for k in range(1, 5)]
        d = lm.discounts(n)
        by = Counter()
        total = Counter()
        for v in contexts:
            by[low(v)] += 1
            total[low(v)] += v
        left = lambda c: max(0, c - d[min(c, 3) - 1]) if c else 0
        a, b = 0.0, 1.0
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if sum(by[k] * (total[k] / by[k]) ** m for k in by) < kinds else (a, m)
        share = lambda q: max(left(low(k)) / low(k) for k in range(1, q + 1))
        return left, lambda q: d[0] * q**a, share

    s2 = smoothing(c2, c1.values(), len(c2) + 1)
    pairs = {**c2, "<s>": n_texts} if n_texts else c2
    s3 = smoothing(c3, pairs.values(), len(c3))

    def step(smooth, c, q, below):
        left, back, share = smooth
        if not q:
            return below
        return (left(low(c)) + back(q) * below) / (q * share(q) + back(q))

    def p(u, v, w):
        p1 = (low(c1[w]) + 0.5) / space
        q1 = high(n_texts if v == "<s>" else c1[v])
        pair = c2[v, w]
        k2 = min(low(pair), low(c1[w]), q1)
        q2 = high(n_texts if v == "<s>" else c2[u, v])
        k3 = min(low(c3[u, v, w]), k2, q2)
        return step(s3, k3, q2, step(s2, k2, q1, p1))

    score = lambda t: sum(math.log10(p(*x)) for x in zip(text(t), text(t)[1:], text(t)[2:], strict=False))
    return p, c1, [(i, score(t)) for i, t in rows]


def corpus():
    r = __import__("random").Random(6)
    weights = [1 / (k + 1) for k in range(30)]
    text = lambda: " ".join(r.choices([f"w{k}" for k in range(30)], weights, k=r.randint(0, 25)))
    rows = [(k, text()) for k in range(150)]
    return rows + [(200 + k, rows[k][1]) for k in range(20)] + [(300, None), (301, ""), (None, "w1 w2 unknown"), (302, "W1 w1\tW1\n w1 " * 40), (302, "w1")]


@pytest.mark.parametrize("options", [{}, {"group_bytes": 8, "head_words": 3}])
def test_score_against_brute_force(docs_of, options):
    rows = corpus()
    _, _, wanted = brute_scores(rows)
    found = lm.score(docs_of([(i, t, "en", "s") for i, t in rows]), spread=20, **options).collect()  # so wide that no probe errs
    assert len(found) == len(rows)
    for (i, x), (k, y) in zip(sorted(((r["doc_id"], r["score"]) for r in found), key=str), sorted(wanted, key=str), strict=True):
        assert i == k and abs(x - y) < 1e-6, (i, x, y)


def test_probabilities_add_up_to_one_at_most():
    p, c1, _ = brute_scores(corpus())
    words = [*c1, "unknown"]
    for u, v in [("<s>", "<s>"), ("<s>", "w0"), ("w0", "w1"), ("w5", "w3"), ("unknown", "w2"), ("w29", "w28"), ("unknown", "unknown")]:
        total = sum(p(u, v, w) for w in words)
        assert 0.3 < total <= 1 + 1e-9, (u, v, total)


@pytest.mark.parametrize("most", [0, 2, 7])
def test_head_is_bounded_whatever_the_counts(docs_of, monkeypatch, most):
    """51 words with thousands of occurrences each."""
    seen, head_of = [], lm.head_of

    def watched(*a):
        found = head_of(*a)
        seen.append(len(found[0]))
        return found

    monkeypatch.setattr(lm, "head_of", watched)
    rows = [(k, " ".join(f"w{j}" for j in range(51)) + " often often", "en", "s") for k in range(400)]
    one = {r["doc_id"]: r["base_score"] for r in lm.score(docs_of(rows), head_words=most).collect()}
    assert seen[0] <= most
    assert all(abs(one[r["doc_id"]] - r["base_score"]) < 1e-6 for r in lm.score(docs_of(rows)).collect())


def test_a_very_long_text(docs_of):
    long = " ".join(f"w{k % 977}" for k in range(1_500_000))
    found = {r["doc_id"]: r for r in lm.score(docs_of([(1, long, "en", "s"), (2, "w1 w2 w3", "en", "s")])).collect()}
    assert found[1]["n_tokens"] == 1_500_001 and found[2]["n_tokens"] == 4 and found[1]["score"] > found[1]["base_score"]


def test_empty(docs_of):
    assert lm.score(docs_of([])).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    (row,) = lm.score(docs_of([(held, "a b", "en", "s")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and math.isfinite(row["score"])


def test_score_does_not_depend_on_the_head(docs_of):
    """The context counts of words outside the head are those inside it; ``often`` is seen 40 times and twice before ``x``."""
    rows = [(k, f"often {'x' if k < 3 else f'y{k}'} alpha beta gamma{k % 5} w{k // 2}", "en", "s") for k in range(60)]
    for group_bytes in (1 << 20, 8):
        by = [{r["doc_id"]: r["score"] for r in lm.score(docs_of(rows), head_words=n, group_bytes=group_bytes).collect()} for n in (1 << 20, 3)]
        assert all(abs(by[0][k] - other[k]) < 1e-9 for other in by[1:] for k in by[0])


def test_pairs_seen_once_count(docs_of):
    """``y`` and ``z`` are equally frequent; after ``h`` training has ``y`` once and ``z`` never."""
    train, held = ([k for k in range(400) if (zlib.crc32(str(k).encode()) % 5 == 1) == b] for b in (False, True))
    rows = [(k, "h x", "en", "s") for k in train[:60]] + [(train[60], "h y", "en", "s"), (train[61], "x z", "en", "s")] + [(held[0], "h y", "en", "s"), (held[1], "h z", "en", "s")]
    found = {r["doc_id"]: r for r in lm.score(docs_of(rows)).collect()}
    assert found[held[0]]["base_score"] == found[held[1]]["base_score"] and found[held[0]]["score"] > found[held[1]]["score"] + 0.1


def test_smoothing_comes_from_all_training_texts(docs_of, monkeypatch):
    seen, tables = [], lm.tables
    monkeypatch.setattr(lm, "tables", lambda *a: seen.append(int(a[2].sum())) or tables(*a))
    (row, *_) = lm.score(docs_of([(k, f"a b{k % 9}", "en", "s") for k in range(6000)])).collect()
    assert seen[0] == row["train_tokens"]


def test_filters_do_not_pass_through_the_driver(docs_of, monkeypatch):
    """What the driver collects and sends out stays the same when the n-grams grow."""
    import pickle

    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame

    seen = [0]
    collect, broadcast = DataFrame.collect, SparkContext.broadcast

    def collected(df):
        rows = collect(df)
        seen[0] += sum(len(v) if isinstance(v, bytes | bytearray) else 8 for r in rows for v in r)
        return rows

    def sent(context, value):
        seen[0] += len(pickle.dumps(value))
        return broadcast(context, value)

    monkeypatch.setattr(DataFrame, "collect", collected)
    monkeypatch.setattr(SparkContext, "broadcast", sent)
    found = []
    for n in (200, 2_000):
        seen[0] = 0
        lm.score(docs_of([(k, " ".join(f"w{k * 30 + j}" for j in range(30)), "en", "s") for k in range(n)]), head_words=3)
        found.append(seen[0])
    assert found[1] <= 1.2 * found[0] + 10_000, found


def test_questions_wait_in_a_file_in_their_order():
    for most in (1, 1 << 20):
        asked = lm.Asked(most)
        rows = [(k, bytes([k]) * (k * 37 % 11)) for k in range(50)]
        for k, data in rows:
            asked.add(k, data)
        assert list(asked) == rows
