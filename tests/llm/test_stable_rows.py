"""Results don't depend on how files are split, which follows the cores that are there when a job starts."""

import random
import re

import pytest

from marlstone.llm import common
from marlstone.llm.decontaminate import decontaminate
from marlstone.llm.exact_dedup import exact_dedup
from marlstone.llm.jaccard_join import similarity_join
from marlstone.llm.substring_dedup import remove_repeats


@pytest.fixture
def unsteady(spark, monkeypatch):
    """Each written table changes the number and the size of the splits of the jobs after it."""
    names, turn, scratch = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), [0], common.scratch

    def changing(session, name):
        turn[0] += 1
        values = (("4", "128m", "4m"), ("12", "8k", "1k"), ("2", "1g", "1m"))[turn[0] % 3]
        for k, v in zip(names, values, strict=True):
            session.conf.set(k, v)
        return scratch(session, name)

    monkeypatch.setattr(common, "scratch", changing)
    yield
    for k in names:
        spark.conf.unset(k)


def texts():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60)) + "."
    rows = []
    for k in range(300):
        own = " ".join(word() + ("." if r.random() < 0.2 else "") for _ in range(80))
        rows.append((k, own if k % 3 else f"{own}. {passage} {own[:40]}", "en", f"s{k % 4}"))
        if k % 10 == 0:
            rows += [(1000 + k, own, "en", "s0"), (2000 + k, own + " one more", "en", "s1")]
    return rows, passage


def test_same_rows_whatever_the_splits(spark, docs_of, tmp_path, unsteady):
    import corpus_pipeline

    rows, passage = texts()
    docs_of(rows).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(k, " ".join(passage.split()[k : k + 12])) for k in range(3)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {i: t for i, t, _, _ in rows}
    plants = {k for k in range(300) if k % 3 == 0}

    leaks = decontaminate(docs, items, block_bytes=40).collect()
    assert {r["doc_id"] for r in leaks if r["contaminated"]} == plants and len(leaks) == len(rows)

    cut = {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()}
    for k in plants - {0}:  # sentences of this very document, and not of another, are left
        assert passage not in cut[k] and all(s in text[k] for s in cut[k].split("."))

    near = {r["doc_id"]: r["class_id"] for r in similarity_join(docs).collect()}
    assert all(near[1000 + k] == near[2000 + k] for k in range(0, 300, 10))
    kept = {r["doc_id"] for r in exact_dedup(docs).where("kept").collect()}
    assert len(kept) == len({t for t in text.values()})

    left = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert left == [k for k in range(300) if k % 3 and k % 10] + [1000 + k for k in range(0, 300, 10)]


def test_numbers_are_written(spark):
    rows = common.numbered(spark.range(100).withColumnRenamed("id", "x"), "test")
    one = {r["x"]: r["row"] for r in rows.collect()}
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "13")
    try:
        assert {r["x"]: r["row"] for r in rows.collect()} == one
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_no_temporary_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda key: None)}))

    with pytest.raises(ValueError, match=re.escape("spark.checkpoint.dir")):
        common.shared_dir(Session)
