"""N-gram Jaccard join by chosen paths.

Sets are the 5-word shingles of a text (a shorter text is one shingle). Texts with equal sets form one class.

1. Sketches. Each class has a signature of ``SIGNATURE`` min-hashes; a min-hash samples a token of the set, and two sets
   share it with the probability of their similarity.
2. Chosen paths. In each run a set goes to the bucket of one sampled token. Buckets of at most ``LIMIT`` sets are compared
   by brute force on the signatures. Larger ones split again on two further sampled tokens, ``LEVELS`` times at most; a large bucket that
   hardly shrinks, or is at the last level, (it holds hardly anything but similar sets) becomes one group of the next step as it is. Runs are repeated
   until a pair at the threshold is met with the probability ``recall``. A bucket yields the links of a spanning forest, not its pairs.
3. Groups. Connected components of these links hold every pair that was met.
4. Verification. Within a group all pairs whose signatures don't rule them out are compared exactly, in blocks of at most about
   ``BLOCK`` sets and ``BLOCK_BYTES`` of shingles a side, each in a task of its own. Each set goes to as many tasks as its group has blocks: the links of each set are counted exactly, so
   a group of n different texts costs n * n / ``BLOCK`` rows and n * n / 2 comparisons, and no fewer. A block yields for each set the number of its links and one link of a spanning forest.
5. The components of the verified links are the classes of near duplicates.

No step puts out a row for each pair, and none gathers a bucket or a group of unbounded size in one task: rows of large
buckets pass through, large groups are cut to blocks.

Texts without words are linked to nothing; an empty table gives no rows; very long texts are one set like any other. Repeated rows and equal texts are links of each other. Null ids are ignored in
class_id and set_id unless there is no other. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, components, few, filter_has, filter_of, lean, materialize, numbered, partitions, reclaim, row_number, sorted_unique, utf8

SIGNATURE = 64
LIMIT = 4096
LEVELS = 5
#: A bucket that keeps more than this share of its parent's sets holds similar sets; splitting it further would only multiply its rows.
STAYS = 0.75
BLOCK = 2048
BLOCK_BYTES = 16 << 20
BATCH_WORDS = 1 << 20
#: Bits of the filter that keeps texts without a partner from being sent again; it only spares work.
FILTER_BITS = 1 << 26
_U = np.uint64
_FACTORS = np.random.default_rng(20240501).integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 1 << 17:
            self.clear()
        return h


def shingles(text: bytes, n: int, hashes: _Hashes) -> np.ndarray:
    """Hashes of the distinct runs of ``n`` words, sorted."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = min(n, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = _mix(s ^ h[k : len(h) - n + 1 + k]) * _U(0x9E3779B97F4A7C15)
    return sorted_unique(s)


def minhashes(s: np.ndarray) -> np.ndarray:
    out = np.full(SIGNATURE, ~_U(0), np.uint64)
    for a in range(0, len(s), 8192):
        np.minimum(out, (s[a : a + 8192, None] * _FACTORS).min(0), out=out)
    return _mix(out)


def _sketch(batches: Iterator[pa.RecordBatch], n: int, runs: int) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    salt = _mix(np.arange(1, runs + 1, dtype=np.uint64))
    for batch in batches:
        size, digest, sig, keys = [], [], [], []
        for t in batch.column("text"):
            s = shingles(t.as_py(), n, hashes)
            m = minhashes(s)
            size.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig.append(m.astype(np.uint16).tobytes())
            keys.append(_mix(m[:runs] + salt).view(np.int64))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys) if keys else [], pa.int64()), runs)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(size, pa.int32()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), flat.cast(pa.list_(pa.int64()))], ["row", "id", "size", "digest", "sig", "keys"])


def _signatures(sig: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint16).reshape(len(sig), SIGNATURE)


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which signatures agree in at least that share; a matrix."""
    out = np.zeros((len(a), len(b)), bool)
    step = max(1, (1 << 22) // max(1, len(b) * SIGNATURE))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] == b[None, :, :]).sum(2, dtype=np.uint8) >= least * SIGNATURE
    return out


def _roots(sig: np.ndarray, least: float) -> np.ndarray:
    """The least index that each signature is connected to by pairs that are alike, breadth first."""
    root = np.full(len(sig), -1)
    left = np.arange(len(sig))
    while len(left):
        top, front, left = left[0], left[:1], left[1:]
        root[top] = top
        while len(front) and len(left):
            met = _alike(sig[left], sig[front], least).any(1)
            front, left = left[met], left[~met]
            root[front] = top
    return root


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[list]]:
    """Rows with equal first columns, which come together; the groups are of bounded size."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if row[0] != at:
                if rows:
                    yield rows
                at, rows = row[0], []
            rows.append(row)
    if rows:
        yield rows


def _brute(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the small buckets."""
    a, b = [], []
    for rows in _groups(batches, ("key", "rep", "sig")):
        sig = _signatures([r[2] for r in rows])
        root = _roots(sig, least)
        for i in np.flatnonzero(root != np.arange(len(rows))).tolist():
            a.append(rows[i][1])
            b.append(rows[root[i]][1])
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a set with others."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum([0, *(len(m) for m in many[:-1])]))


def _verify(batches: Iterator[pa.RecordBatch], least: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each set of a block: links to documents and to classes, and a set of the block that it is connected to."""
    for rows in _groups(batches, ("task", "side", "rep", "n", "sig", "set")):
        left = [r for r in rows if r[1] <= 0]  # sides: 0 and 1 are two blocks, -1 is one block with itself
        right = left if rows[0][1] < 0 else [r for r in rows if r[1] == 1]
        out: dict[int, list[int]] = {r[2]: [0, 0, r[2]] for r in rows}
        if left and right:
            sets = [np.frombuffer(r[5], np.uint64) for r in right]
            size = np.array([len(s) for s in sets])
            own = [np.frombuffer(r[5], np.uint64) for r in left]
            alike = _alike(_signatures([r[4] for r in left]), _signatures([r[4] for r in right]), least)
            up = {r[2]: r[2] for r in rows}

            def top(x: int, up: dict[int, int] = up) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for i, r in enumerate(left):
                n = len(own[i])
                may = alike[i] & (np.minimum(size, n) >= threshold * np.maximum(size, n) - 1e-9)
                if rows[0][1] < 0:
                    may[: i + 1] = False
                partners = np.flatnonzero(may)
                if not len(partners):
                    continue
                both = _shared(own[i], [sets[j] for j in partners])
                partners = partners[both >= threshold * (n + size[partners] - both) - 1e-9]
                for j in partners.tolist():
                    q = right[j]
                    out[r[2]][0] += q[3]
                    out[r[2]][1] += 1
                    out[q[2]][0] += r[3]
                    out[q[2]][1] += 1
                    x, y = top(r[2]), top(q[2])
                    up[max(x, y)] = min(x, y)
            for x in out:
                out[x][2] = top(x)
        cols = [list(out), *zip(*out.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "links", "classes", "root"])


def _sets(batches: Iterator[pa.RecordBatch], sent, n: int) -> Iterator[pa.RecordBatch]:
    """Shingles of the texts that the filter lets through."""
    hashes = _Hashes()
    for batch in batches:
        row = batch.column("row").to_numpy()
        some = np.flatnonzero(filter_has(sent.value, row))
        text = batch.column("text")
        sets = [shingles(text[i].as_py(), n, hashes).tobytes() for i in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(sets, pa.binary())], ["rep", "set"])


def block_tasks(members: DataFrame) -> DataFrame:
    """A row for each set and each task that compares its block with a block of its group: task, and side -1 (a block with itself), 0 or 1."""
    tasks = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return tasks.withColumns({"side": side, "task": F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other"))})


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9999, row_col: str | None = None) -> DataFrame:
    """Per document: row (its number), id, class_id (least id of its component), set_id (least id of equal sets), n_links (documents linked), n_classes (sets linked), first (whether it is the row that stays for its class). ``row_col``: a column of row numbers that are the same in every scan; without one the texts are numbered and written once."""
    spark = docs.sparkSession
    id_field = docs.schema[id_col].dataType.simpleString()
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - (2 * threshold - 1) / threshold)))
    least = max(1 / SIGNATURE, threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / SIGNATURE))
    rows = docs.select(docs[id_col].alias("id"), utf8(docs[text_col]).alias("text"), *([] if row_col is None else [row_number(row_col).alias("row")]))
    rows = numbered(rows, "join-docs") if row_col is None else rows
    sketches = materialize(rows.mapInArrow(lean(lambda it: _sketch(it, words, runs)), f"row long, id {id_field}, size int, digest binary, sig binary, keys array<long>"), "join-sketches")
    classes = materialize(sketches.where("size > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("id").alias("set_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("head")), "join-classes")

    # chosen paths
    paths = sketches.where("size > 0").join(classes.select(F.col("rep").alias("row")), "row").select(F.explode("keys").alias("key"), F.col("row").alias("rep"), "sig", F.lit(None).cast("long").alias("parent"))
    edges = None
    for level in range(LEVELS + 1):
        counts = paths.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("rep").alias("least")).where("count > 1")
        met = materialize(paths.join(counts, "key"), f"join-level{level}")
        small = met.where(F.col("count") <= LIMIT).repartition(partitions(spark), "key").sortWithinPartitions("key").select("key", "rep", "sig")
        found = materialize(small.mapInArrow(lean(lambda it: _brute(it, least)), "a long, b long"), "join-met")
        edges = found if edges is None else edges.union(found)
        large = met.where(F.col("count") > LIMIT)
        if large.isEmpty():
            break
        whole = F.lit(True) if level == LEVELS else F.coalesce(F.col("count") > STAYS * F.col("parent"), F.lit(False))
        edges = edges.union(large.where(whole).select(F.col("rep").alias("a"), F.col("least").alias("b")))
        # two tokens that no level above has used
        width = (SIGNATURE - runs) // LEVELS
        one = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(width))
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("key", F.lit(2)), F.lit(width - 1)), F.lit(width))
        child = F.explode(F.array(*(x + (runs + level * width) for x in (one, two))))
        at = large.where(~whole).select("key", "rep", "sig", F.col("count").alias("parent"), child.alias("at"))
        paths = at.select(F.xxhash64("key", "at", F.substring("sig", F.col("at").cast("int") * 2 + 1, F.lit(2))).alias("key"), "rep", "sig", "parent")
    reclaim(spark)

    # groups, cut to blocks
    groups = components(edges, "join-groups")
    of_group = groups.join(sketches.select(F.col("row").alias("node"), "size"), "node").groupBy("label")
    sizes = of_group.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).alias("blocks"))
    placed = groups.join(sizes, "label").select(F.col("node").alias("rep"), "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    n = groups.count()
    placed = materialize(few(placed, n), "join-placed")
    sent = spark.sparkContext.broadcast(filter_of(placed.select("rep"), FILTER_BITS))
    sets = rows.select("row", "text").mapInArrow(lean(lambda it: _sets(it, sent, words)), "rep long, set binary")
    members = placed.join(classes.select("rep", "n"), "rep").join(sketches.select(F.col("row").alias("rep"), "sig"), "rep").join(sets, "rep")
    members = materialize(members, "join-members")
    sent.unpersist()
    dealt = block_tasks(members).select("task", "side", "rep", "n", "sig", "set").repartition(partitions(spark), "task").sortWithinPartitions("task", "side", "rep")
    verified = materialize(dealt.mapInArrow(lean(lambda it: _verify(it, least, threshold)), "rep long, links long, classes long, root long"), "join-verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))
    labels = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")), "join-linked")

    known = classes.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    tops = known.groupBy("label").agg(F.min("set_id").alias("class_id"), F.min("head").alias("stays"))
    known = materialize(known.join(tops, "label").select("digest", "set_id", "class_id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("classes", F.lit(0)).alias("classes"), "stays"), "join-known")
    reclaim(spark)
    seen = sketches.select("row", "id", "digest", "size").join(known, "digest", "left")
    alone = (F.col("size") == 0) | F.col("n").isNull()
    return seen.select(
        "row",
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("set_id")).alias("set_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("n") - 1).cast("long").alias("n_links"),
        F.when(alone, 0).otherwise(F.col("classes")).cast("long").alias("n_classes"),
        (alone | (F.col("row") == F.col("stays.row"))).alias("first"),
    )
