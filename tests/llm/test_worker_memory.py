"""What Python workers hold: between tasks, and in a batch on its way to the JVM."""

import subprocess
import sys

import pyarrow as pa

HELD = """
import random, re, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marlstone.llm.decontaminate import build_index
from marlstone.llm.exact_dedup import exact_dedup

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", {shared!r}).getOrCreate()


def held(batches):
    for _ in batches:
        pass
    found = re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())
    yield pa.RecordBatch.from_arrays([pa.array([int(found[0]) / 1024])], ["mb"])


least = spark.range(1).coalesce(1).mapInArrow(held, "mb double").first()[0]
r = random.Random(1)
words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(50_000)]
rows = [(k, " ".join(r.choices(words, k=600))) for k in range(4_000)]
docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
for run in (lambda: exact_dedup(docs).count(), lambda: build_index(docs).count()):
    run()
    print("MB", spark.range(1).coalesce(1).mapInArrow(held, "mb double").first()[0] - least)
"""


def test_workers_keep_no_free_memory(tmp_path):
    """Workers serve one operator after another; what the tasks of one needed must not be held in those of the next."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = tmp_path / "held.py"
    code.write_text(HELD.format(root=root, shared="file://" + str(tmp_path / "shared")))
    out = subprocess.run([sys.executable, str(code)], capture_output=True, text=True, timeout=240, cwd=root, check=False)
    held = [float(x.split()[1]) for x in out.stdout.splitlines() if x.startswith("MB")]
    assert len(held) == 2, out.stderr[-2000:]
    assert max(held) < 50, held


def test_window_leaves_in_pieces(monkeypatch):
    from marlstone.llm import common, exact_dedup

    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 2)

    monkeypatch.setattr(exact_dedup, "TaskContext", Context)
    texts = [b"%06d" % (k % 900) * 2_000 for k in range(1_000)]  # 10.8 MB of distinct texts: one window
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(range(1_000)), pa.array(texts)], ["row", "id", "text"])
    out = list(exact_dedup._local_chains(iter([batch]), pa.int64()))
    assert max(b.nbytes for b in out) <= 2 * common.BATCH_BYTES
    found = pa.Table.from_batches(out)
    assert found["row"].to_pylist() == list(range(1_000)) and sum(found["head"].to_pylist()) == 900
    assert [t for t in found["text"].to_pylist() if t is not None] == texts[:900]


def test_index_is_written_and_read_in_small_row_groups(spark):
    """A row group is what a task of the JVM holds on both ways, whatever the size of the file."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from marlstone.llm.decontaminate import build_index

    text = F.expr("array_join(transform(sequence(1, 1000000), i -> hex(i * (id + 7) % 4093)), ' ')")
    files = build_index(spark.range(0, 8, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))).inputFiles()
    groups = [f.metadata.row_group(k) for f in map(pq.ParquetFile, (p.removeprefix("file://") for p in files)) for k in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 4  # of two texts each
    assert max(g.total_byte_size for g in groups) <= 16 << 20
