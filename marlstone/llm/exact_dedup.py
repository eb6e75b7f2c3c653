"""Exact deduplication with an extendible-hash index on shared files.

1. Local chains. Each scan task chains equal texts of a bounded window (by bytes and rows), comparing bytes. A text with
   billions of copies thus leaves its scan as one entry per window. Where a key has more than ``HOT`` of these, they are chained
   once more, dealt over as many tasks as the square root of their number, and reach the owner as one entry for each of these.
2. Directory. Entries are keyed by the first 64 bits of SHA-256. Buckets that exceed their capacity are split by the next
   bit; where a bucket is as deep as the directory, the directory doubles. It has at most ``2 ** MAX_DEPTH`` slots.
3. Owner tasks. Each owns whole buckets, i.e. key ranges, reads their entries in key order, chains collisions and compares
   bytes. It writes the index, in the order of bucket and key: window entry -> row that stays and size of the group. ``Index.lookup`` finds texts in it by bucket.
4. Rows meet the index by window entry; an entry has a bounded number of rows, so no key is hot.

Nulls count as empty texts. Of equal texts the row with the largest id stays (null ids are smallest); of repeated rows
with that id exactly one stays. An empty table gives an empty result; a text longer than a window is a window by itself. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, partitions, pieces, reclaim, row_number, utf8

WINDOW_BYTES = 16 << 20
WINDOW_ROWS = 50_000
#: Entries of a key that go to its owner at once.
HOT = 1024
#: Buckets that a lookup names to the scan; lookups of more read the index whole.
MOST_BUCKETS = 1000
#: The directory may double this often.
MAX_DEPTH = 18


@dataclass
class Bucket:
    prefix: int
    depth: int
    entries: int


@dataclass
class Directory:
    """Slots of an extendible-hash table; ``slots[key >> (64 - depth)]`` is the bucket."""

    depth: int = 0
    buckets: list[Bucket] = field(default_factory=lambda: [Bucket(0, 0, 0)])
    slots: list[int] = field(default_factory=lambda: [0])

    def double(self) -> None:
        self.slots = [b for b in self.slots for _ in (0, 1)]
        self.depth += 1

    def split(self, at: int, left_entries: int) -> int:
        """Split a bucket by the bit after its prefix; returns the new bucket's number."""
        old = self.buckets[at]
        if old.depth == self.depth:
            self.double()
        new = len(self.buckets)
        self.buckets[at] = Bucket(old.prefix * 2, old.depth + 1, left_entries)
        self.buckets.append(Bucket(old.prefix * 2 + 1, old.depth + 1, old.entries - left_entries))
        span = 1 << (self.depth - old.depth - 1)
        first = (old.prefix * 2 + 1) * span
        self.slots[first : first + span] = [new] * span
        return new


def build_directory(counts: dict[int, int], fine: int, capacity: int) -> Directory:
    """Directory for ``counts`` of entries by the first ``fine`` bits of their keys."""
    sums = [0]
    for i in range(1 << fine):
        sums.append(sums[-1] + counts.get(i, 0))
    found = Directory()
    found.buckets[0].entries = sums[-1]
    todo = [0]
    while todo:
        at = todo.pop()
        b = found.buckets[at]
        if b.entries > capacity and b.depth < fine:
            width = 1 << (fine - b.depth - 1)
            left = sums[b.prefix * 2 * width + width] - sums[b.prefix * 2 * width]
            todo += [at, found.split(at, left)]
    return found


def _local_chains(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, window_rows: int = WINDOW_ROWS) -> Iterator[pa.RecordBatch]:
    """One row per document; the first row of each distinct text of a window carries the text, its size and largest id."""
    base = TaskContext.get().partitionId() << 36
    serial = 0
    ids: list = []
    rows_at: list[int] = []
    entry: list[int] = []
    chains: dict[bytes, list] = {}  # dict compares the bytes of texts whose hashes collide
    held = 0

    def flush() -> pa.RecordBatch:
        n = len(ids)
        best, head, text, size, top, sha = [False] * n, [False] * n, [None] * n, [0] * n, [None] * n, [b""] * n
        rows = {c[0]: (t, c, hashlib.sha256(t).digest()) for t, c in chains.items()}
        seen = set()
        for i, e in enumerate(entry):
            t, c, digest = rows[e]
            sha[i] = digest
            best[i] = i == c[1]
            if e not in seen:
                seen.add(e)
                head[i], text[i], size[i], top[i] = True, t, c[2], ids[c[1]]
        key = [int.from_bytes(s[:8], "big", signed=True) for s in sha]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows_at, pa.int64()), pa.array(ids, id_type), pa.array(entry, pa.int64()), pa.array(best), pa.array(sha, pa.binary()), pa.array(key, pa.int64()), pa.array(head), pa.array(size, pa.int64()), pa.array(top, id_type), pa.array(text, pa.binary())],
            ["row", "id", "entry", "best", "sha", "key", "head", "size", "top", "text"],
        )

    for batch in batches:
        for row, i, t in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
            t = t.as_py()
            c = chains.get(t)
            if c is None:
                c = chains[t] = [base + serial, len(ids), 0]
                serial += 1
                held += len(t)
            elif i is not None and (ids[c[1]] is None or i > ids[c[1]]):
                c[1] = len(ids)
            c[2] += 1
            rows_at.append(row)
            ids.append(i)
            entry.append(c[0])
            if held >= WINDOW_BYTES or len(ids) >= window_rows:
                yield from pieces(flush())
                rows_at, ids, entry, chains, held = [], [], [], {}, 0
    if ids:
        yield from pieces(flush())


def _own(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, key_type: pa.DataType = pa.int64()) -> Iterator[pa.RecordBatch]:
    """Chains of each key of the buckets that a task owns; rows come in the order of bucket and key.

    A row for each entry: the chain's largest id, the entry that has it, the size, the chain's place (link); the first entry of a chain carries its text.
    """
    names = ["entry", "keep_id", "keep_entry", "group_size", "link", "key", "text"]
    types = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.int32(), key_type, pa.binary()]
    out: list[tuple] = []
    held = 0
    at = None
    chain: list[list] = []  # text, size, largest id, entry of that id, entries

    def close() -> None:
        nonlocal held
        for link, (text, size, top, keep, members) in enumerate(chain):
            out.extend((e, top, keep, size, link, at, None if k else text) for k, e in enumerate(members))
            held += len(text)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for b in batches:
        for key, e, size, top, t in zip(*(b.column(n).to_pylist() for n in ("key", "entry", "size", "top")), b.column("text"), strict=True):
            t = t.as_py()
            if key != at:
                close()
                at, chain = key, []
            for c in chain:
                if c[0] == t:
                    c[1] += size
                    if top is not None and (c[2] is None or top > c[2] or top == c[2] and e < c[3]) or top is None and c[2] is None and e < c[3]:
                        c[2], c[3] = top, e
                    c[4].append(e)
                    break
            else:
                chain.append([t, size, top, e, [e]])
            if len(out) >= 10_000 or held >= 4 << 20:
                yield batch()
                out, held = [], 0
    close()
    if out:
        yield batch()


def _parts(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """As _own, for rows whose key is (key, salt)."""
    for batch in _own(batches, id_type, pa.struct([("key", pa.int64()), ("salt", pa.int64())])):
        at = batch.schema.get_field_index("key")
        yield batch.set_column(at, "key", batch.column(at).field("key"))


@dataclass(frozen=True)
class Index:
    """The written index: ``table`` has a row for each entry (bucket, key, entry, keep_id, keep_entry, group_size, and whether it leads its chain), in files sorted by bucket and key,
    so that a lookup reads the blocks of its buckets; ``entries`` has the documents by entry, and the text of each."""

    directory: Directory
    slots: DataFrame
    table: DataFrame
    entries: DataFrame
    id_col: str

    def documents(self) -> DataFrame:
        """One row per document: row, id, keep_id, group_size, kept, text_sha256."""
        kept = F.coalesce(F.col("keep_entry") == F.col("entry"), F.lit(False)) & F.col("best")
        found = self.table.select("entry", "keep_id", "keep_entry", "group_size")
        return self.entries.select("row", "id", "entry", "best", "sha").join(found, "entry").select("row", F.col("id").alias(self.id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    def lookup(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """Of each distinct text that the index has: text_sha256, keep_id, group_size. Keys lead to buckets by the directory, and bytes are compared."""
        asked = texts.select(utf8(texts[text_col]).alias("asked")).distinct().withColumn("sha", F.sha2("asked", 256))
        asked = asked.withColumn("key", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")).withColumn("slot", self._slot()).join(F.broadcast(self.slots), "slot")
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().limit(MOST_BUCKETS + 1).collect()]
        table = self.table.where("lead")
        table = table.where(F.col("bucket").isin(buckets)) if len(buckets) <= MOST_BUCKETS else table
        found = table.join(asked, ["bucket", "key"]).join(self.entries.where("head").select("entry", "text"), "entry").where("text = asked")
        return found.select(F.col("sha").alias("text_sha256"), "keep_id", "group_size")

    def _slot(self) -> Column:
        return F.shiftrightunsigned("key", 64 - self.directory.depth) if self.directory.depth else F.lit(0).cast("long")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per document: row (its number), id, keep_id, group_size, kept, text_sha256. Options: as ``build_index``."""
    return build_index(docs, **options).documents()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, row_col: str | None = None, hot: int = HOT, window_rows: int = WINDOW_ROWS) -> Index:
    """Index the texts.

    ``capacity``: entries of a bucket. ``row_col``: the caller's column of stable row numbers; else ``row`` is a number of this run. ``hot``: entries of a key
    beyond which they are chained in two steps. ``window_rows``: rows whose equal texts a scan task chains.
    """
    spark = docs.sparkSession
    id_field = docs.schema[id_col].dataType
    id_type = docs.limit(0).select(id_col).toArrow().schema.field(0).type
    local = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("id", id_field), T.StructField("entry", T.LongType()), T.StructField("best", T.BooleanType()), T.StructField("sha", T.BinaryType()), T.StructField("key", T.LongType())]
        + [T.StructField("head", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("top", id_field), T.StructField("text", T.BinaryType())]
    )
    rows = docs.select(docs[id_col].alias("id"), utf8(docs[text_col]).alias("text"), row_number(row_col).alias("row"))  # scanned once
    entries = materialize(rows.mapInArrow(lean(lambda it: _local_chains(it, id_type, window_rows)), local), "dedup-entries")
    heads = entries.where("head").select("key", "entry", "size", "top", "text")
    chained = T.StructType(
        [T.StructField("entry", T.LongType()), T.StructField("keep_id", id_field), T.StructField("keep_entry", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("link", T.IntegerType())]
        + [T.StructField("key", T.LongType()), T.StructField("text", T.BinaryType())]
    )

    # entries of hot keys: chained in about sqrt(n) parts first, so that no task gets more than about that many texts of a key
    often = materialize(heads.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "dedup-hot")
    chains = None
    if not often.isEmpty():
        salt = F.pmod(F.xxhash64("entry"), F.ceil(F.sqrt("n"))).alias("salt")
        parts = heads.join(often, "key").select("key", "entry", "size", "top", "text", salt).repartition(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", "entry")
        group = F.struct("key", "salt").alias("key")
        chains = materialize(parts.select(group, "entry", "size", "top", "text").mapInArrow(lean(lambda it: _parts(it, id_type)), chained), "dedup-parts")
        leads = chains.where("text IS NOT NULL").select("key", F.col("keep_entry").alias("entry"), F.col("group_size").alias("size"), F.col("keep_id").alias("top"), "text")
        heads = heads.join(often, "key", "left_anti").unionByName(leads)

    total = heads.count()
    capacity = capacity or max(512, total >> (MAX_DEPTH - 2))
    fine = min(MAX_DEPTH, max(1, (total // capacity).bit_length() + 2))
    prefix = F.shiftrightunsigned("key", 64 - fine)
    counts = dict(heads.groupBy(prefix.alias("p")).count().collect())  # at most 2 ** fine rows
    directory = build_directory(counts, fine, capacity)
    slot = F.shiftrightunsigned("key", 64 - directory.depth) if directory.depth else F.lit(0).cast("long")
    slots = spark.createDataFrame(list(enumerate(directory.slots)), "slot long, bucket int")

    owned = (
        heads.select("key", "entry", "size", "top", "text", slot.alias("slot"))
        .join(F.broadcast(slots), "slot")  # at most 2 ** MAX_DEPTH slots of 12 bytes
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "key", "entry")
    )
    index = owned.select("key", "entry", "size", "top", "text").mapInArrow(lean(lambda it: _own(it, id_type)), chained)
    index = index.select("key", "entry", "keep_id", "keep_entry", "group_size", F.col("text").isNotNull().alias("lead"), slot.alias("slot")).join(F.broadcast(slots), "slot").drop("slot")
    found = materialize(index, "dedup-index")
    if chains is not None:
        of_part = chains.select(F.col("entry").alias("member"), F.col("keep_entry").alias("entry"), F.col("entry").eqNullSafe(F.col("keep_entry")).alias("own"))
        part = of_part.join(found, "entry").select("bucket", "key", F.col("member").alias("entry"), "keep_id", F.when(F.col("own"), F.col("keep_entry")).alias("keep_entry"), "group_size", (F.col("own") & F.col("lead")).alias("lead"))
        found = found.join(often.select("key"), "key", "left_anti").unionByName(part)
    reclaim(spark)
    return Index(directory, slots, found, entries, id_col)
