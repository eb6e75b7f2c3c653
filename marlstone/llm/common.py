"""Helpers that the training-data operators share: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of scratch tables not yet deleted.
_SCRATCH: list[str] = []

#: Maps lower-cased UTF-8 bytes: digits, a-z and all non-ASCII bytes stay, all else becomes a space.
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def ascii_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text; none for null."""
    return text.lower().translate(_WORD_BYTES).split() if text else []


def ascii_blanks(text: bytes) -> bytes:
    """The text with its ``ascii_words`` lower-cased and blanks for all else."""
    return text.lower().translate(_WORD_BYTES)


def word_numbers(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts in which blanks alone part them: the distinct words, the words of all texts as numbers of these, and how many each text has."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string(), safe=False))
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy()
    distinct = coded.dictionary.cast(pa.binary())
    real = pc.binary_length(distinct).to_numpy() > 0  # the splitter gives empty words at the ends of a text
    ends = np.concatenate(([0], np.cumsum(real[numbers]))) if len(real) else np.zeros(1, np.int64)
    offsets = lists.offsets.to_numpy()
    counts = ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]
    if real.all():
        return distinct, numbers, counts
    renumbered = (np.cumsum(real) - 1).astype(np.int32)
    return distinct.filter(pa.array(real)), renumbered[numbers[real[numbers]]], counts


def hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)


#: Bytes of an Arrow batch. Spark's own bound is 64 MB, and a batch exists several times over on its way to a task and back.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches, so that many long texts don't meet in one. For applications (the registered queries, the pipeline); operators leave settings alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(name)))
    if now is None or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@cache
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim; None where the C library lacks it."""
    try:
        found = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None
    found.argtypes = [ctypes.c_size_t]
    return found


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, which returns free memory after each batch and at its end. Python workers outlive their tasks and serve all operators: each would keep the most that any of its tasks needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in work(batches):
                yield batch
                del batch
                give_back()
        finally:
            give_back()

    return run


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``BATCH_BYTES``, for each exists whole on both sides of its way to the JVM."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local master may go without: it gets a temporary folder, and the session's settings stay as they are."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster it must be one that the driver and all executors share")
        path = _own_folder()
    return path.rstrip("/")


@cache
def _own_folder() -> str:
    own = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def scratch_paths() -> list[str]:
    """Scratch paths that aren't deleted yet, in the order they were made."""
    return list(_SCRATCH)


def release(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> list[str]:
    """Delete scratch tables, except those that ``keep`` still reads; returns the ones left."""
    used = list(keep._jdf.inputFiles()) if keep is not None else []
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    left = []
    for path in paths:
        tail = path.rsplit("/", 1)[1]
        if any(tail in f for f in used):
            left.append(path)
            continue
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _SCRATCH.remove(path)
    reclaim(spark)
    return left


def reclaim(spark: SparkSession) -> None:
    """Let the driver drop references to finished shuffles, so that executors delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Parquet settings for rows of megabytes. A writer holds a row group, and looks at its size after 100 rows only; a reader decodes up to 4096 rows of a group at once. So each would hold all rows of a file.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors. ``options`` are those of the writer."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: Column) -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a registered query, whose session gets the bound on Arrow batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str, column: str = "row") -> DataFrame:
    """The rows with a number each, written once and read back. A number made anew in each scan would follow the splits of the files, which follow the cores that are there when a job starts."""
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), name)


def row_number(row_col: str | None) -> Column:
    """The caller's column of stable row numbers, else numbers that hold for a single scan."""
    return F.monotonically_increasing_id() if row_col is None else F.col(quoted(row_col)).cast("long")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sorted_unique(a: np.ndarray) -> np.ndarray:
    """As np.unique, by sorting: on random integers many times faster than its hash table."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of about that many thin rows, in partitions of half a million, so that small tables are few files."""
    return df.coalesce(max(1, -(-rows // 500_000)))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of (a, b): node, label (the least node of the component).

    Each round hooks every label to its least neighbour, follows that twice, and contracts the edges; rounds are
    logarithmic in the longest path. Edges stay distributed; each round's tables are written.
    """
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(pair(edges), f"{name}-edges")
    n = edges.count()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = materialize(few(nodes.withColumn("label", F.col("node")), 2 * n), f"{name}-labels")
    while n:
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up"))
        for _ in range(2):
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up").select("a", F.col("top").alias("up"))
        hook = materialize(few(hook, 2 * n), f"{name}-tops")
        labels = materialize(few(labels.join(hook.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), 2 * n), f"{name}-labels")
        moved = edges.join(hook, "a").select(F.col("up").alias("a"), "b").join(hook.select(F.col("a").alias("b"), F.col("up").alias("to")), "b").select("a", F.col("to").alias("b"))
        edges = materialize(few(pair(moved), n), f"{name}-edges")
        n = edges.count()
    return labels


def _filter_bit(keys: np.ndarray, bits: int) -> np.ndarray:
    h = keys.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) % np.uint64(bits)


def filter_of(keys: DataFrame, most_bits: int) -> bytes | None:
    """One-probe Bloom filter of a column of longs, or None where one of ``most_bits`` bits would be too full to spare work. It only spares work: what it lets through is joined exactly.

    Each task fills a range of the bits, for a million keys or so; the driver gets every range once.
    """
    n = keys.count()
    if n * 4 > most_bits:
        return None
    bits = 1 << max(10, min(most_bits.bit_length() - 1, (n * 16).bit_length()))
    ranges = 1 << max(0, min(bits.bit_length() - 11, (n >> 20).bit_length()))
    width = bits // ranges

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _filter_bit(batch.column(0).to_numpy(), bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((b // width).astype(np.int32)), pa.array(b % width)], ["part", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = (batch.column(c).to_numpy() for c in ("part", "bit"))
            for k in sorted_unique(part).tolist():
                own = found.setdefault(k, np.zeros(width // 8, np.uint8))
                b = bit[part == k]
                np.bitwise_or.at(own, b >> 3, np.uint8(1) << (b & 7).astype(np.uint8))
        for k, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "bits"])

    placed = keys.mapInArrow(lean(place), "part int, bit long").repartition(ranges, "part")
    out = np.zeros(bits // 8, np.uint8)
    for part, own in placed.mapInArrow(lean(fill), "part int, bits binary").collect():  # most_bits in all
        out[part * width // 8 : (part + 1) * width // 8] = np.frombuffer(bytes(own), np.uint8)
    return out.tobytes()


def filter_has(bits: bytes | None, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a filter; all where there is none."""
    if bits is None:
        return np.ones(len(keys), bool)
    table = np.frombuffer(bits, np.uint8)
    b = _filter_bit(keys, len(bits) * 8)
    return (table[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
