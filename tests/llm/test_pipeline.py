import pytest


def test_pipeline(spark, docs_of, tmp_path):
    import corpus_pipeline as c

    r = __import__("random").Random(4)
    text = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7))) for _ in range(n))
    base, leak = text(80), text(14)
    rows = [(k, text(60), "en", f"s{k % 3}") for k in range(30)]
    rows += [(40, base, "en", "s0"), (41, base, "en", "s1"), (42, base + " tail", "en", "s2"), (43, text(20) + " " + leak + " " + text(9), "en", None), (44, None, "en", "s0"), (45, "123 !!", None, "s0"), (41, base, "en", "s1")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = c.run(spark, str(tmp_path)).collect()
    # of 40 and 41 the larger id stays, then the least of the near copies; leak, null and letterless texts are gone
    assert sorted(x["doc_id"] for x in found) == sorted([*range(30), 41])
    assert sum(x["taken"] for x in found) == pytest.approx(1.5 * sum(x["size"] for x in found), abs=5)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(c.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")


def brute(rows, found_language, items):
    """Stages 2 to 5 by hand, on the rows that the language stage keeps: the ids that are left, and what the mix may take by source."""
    import test_decontaminate
    import test_jaccard_join
    import test_mixing

    rows = [r for r in rows if found_language(r)]
    last = {}
    for k, (i, t, _, _) in enumerate(rows):
        if t not in last or i >= rows[last[t]][0]:
            last[t] = k
    rows = [rows[k] for k in sorted(last.values())]
    classes = {i: c for i, _, c in test_jaccard_join.brute([(i, t) for i, t, _, _ in rows])}
    rows = [r for r in rows if classes[r[0]] == r[0]]
    hit = {i for i, *_, bad in test_decontaminate.brute([(i, t) for i, t, _, _ in rows], items) if bad}
    rows = [r for r in rows if r[0] not in hit]
    size, target = test_mixing.brute([(i, t, s) for i, t, _, s in rows])
    return {r[0]: r for r in rows}, size, target


def test_against_brute_force(spark, docs_of, tmp_path):
    import math

    import corpus_pipeline as c

    r = __import__("random").Random(11)
    words = {"en": "the of and to in that with for was not are have".split(), "de": "der die und das nicht mit für von ist auf eine auch".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice("abcdef") * r.randint(0, 2) for _ in range(n))
    items = [(1, text("en", 15)), (2, text("de", 11))]
    rows = []
    for k in range(160):
        lang = r.choice(("en", "de"))
        x = r.random()
        t = text(lang, r.randint(30, 90))
        if rows and x < 0.15:  # an exact copy
            _, t, lang, _ = r.choice(rows)
        elif rows and x < 0.35:  # a near copy
            _, t, lang, _ = r.choice(rows)
            t = (t or "") + " " + text(lang, 2)
        elif x < 0.42:
            t = t + " " + r.choice(items)[1] + " " + text(lang, 3)
        elif x < 0.47:
            t = r.choice((None, "", "123 456", "!!"))
        rows.append((k, t, lang, r.choice(("a", "a", "b", None))))
    docs_of(rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {x["doc_id"] for x in c.language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert len([i for i, t, _, _ in rows if t and any(ch.isalpha() for ch in t) and i not in kept]) <= 3
    wanted, size, target = brute(rows, lambda row: row[0] in kept, items)
    found = c.run(spark, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in found) == sorted(wanted)
    taken = dict.fromkeys(size, 0)
    for x in found:
        source = wanted[x["doc_id"]][3]
        assert x["source_size"] == size[source] and abs(x["target"] - target[source]) < 1e-6 and x["taken"] <= 2 * x["size"]
        taken[source] += x["taken"]
    assert taken == {s: math.floor(target[s] + 1e-9) for s in size}


def test_empty_tables(spark, docs_of, tmp_path):
    """The whole pipeline, and each stage alone, on a table without rows; and with a benchmark without rows."""
    import corpus_pipeline as c

    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).collect() == []
    for name, stage in c.STAGES:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert out.collect() == [] and (name == "mix" or out.columns == docs_of([]).columns), name
    rows = [(k, f"the cat and dog number {k}", "en", "s") for k in range(20)]
    assert c.leaks(spark, docs_of(rows), str(tmp_path)).count() == 20
