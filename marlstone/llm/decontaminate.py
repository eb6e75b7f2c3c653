"""Benchmark decontamination with a distributed positional inverted index.

The index holds every word of every training text. It is split by document: each shard (a bounded run of documents) is one stored row that holds, for every
term in the order of the terms' 64-bit hashes, the sorted list of its positions. It is built once, in one scan, and searched by any number of items. A
query intersects the lists of a window's terms, each moved by the term's offset, from the term that is
rarest in the corpus on; with ``slop`` 0 that gives exact phrases, with more it gives proximity matches, in which every
term lies at most ``slop`` positions from its place. Since a shard holds whole documents, no posting is shuffled, and a word that
a third of all texts is made of has a list of bounded length in each shard. Benchmark items go to the workers in blocks of bounded size, a search each.

Null or empty texts have no words and no hits; an empty table gives no rows, an empty benchmark no hits. A very long text is a shard by itself. Items without words never match. Repeated items (equal ids) count once;
a null item id reads ``null``. Repeated documents each get their row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LARGE_ROWS, ascii_blanks, ascii_words, hashes, lean, materialize, row_number, sorted_unique, utf8, word_numbers

WINDOW = 10
SHARD_BYTES = 4 << 20
SHARD_DOCS = 2_000
#: Bytes of item texts that go to the workers at once; a window takes some 100 bytes there.
BLOCK_BYTES = 4 << 20


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[dict[str, list[list[bytes]]]]:
    """Words of the items' texts by item id, in blocks of about ``block_bytes`` of text; streams over the table."""
    block: dict[str, list[list[bytes]]] = {}
    held = 0
    for key, text in items.select(F.coalesce(items[id_col].cast("string"), F.lit("null")), utf8(items[text_col])).toLocalIterator():
        if words := ascii_words(bytes(text)):
            block.setdefault(key, []).append(words)
            held += len(text)
        if held >= block_bytes:
            yield block
            block, held = {}, 0
    yield block


def _shards(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The index: a row for each run of documents, with the positions of every term, by the terms' hashes in order. A gap of one position parts documents."""
    ids: list = []
    rows: list[int] = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        words, numbers, lengths = word_numbers(texts)
        keys = hashes(words)
        order = np.argsort(keys)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        place = np.arange(len(numbers), dtype=np.uint64) + np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
        at = (np.sort(rank[numbers] << np.uint64(32) | place) & np.uint64(0xFFFFFFFF)).astype(np.int32)
        cell = lambda x, t: pa.array([x], pa.list_(t))
        counts = np.bincount(numbers, minlength=len(order))[order].astype(np.int32)
        return pa.RecordBatch.from_arrays([cell(rows, pa.int64()), cell(ids, id_type), cell(lengths.astype(np.int32), pa.int32()), cell(keys[order].view(np.int64), pa.int64()), cell(counts, pa.int32()), cell(at, pa.int32())], ["rows", "ids", "lengths", "terms", "counts", "positions"])

    for batch in batches:
        for row, i, t in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
            text = t.as_py()
            rows.append(row)
            ids.append(i)
            texts.append(ascii_blanks(text))
            held += len(text)
            if held >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                yield flush()
                rows, ids, texts, held = [], [], [], 0
    if ids:
        yield flush()


def _frequency(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """How often the shards of a batch have each of some terms."""
    wanted = sent.value
    for batch in batches:
        seen = np.zeros(len(wanted), np.int64)
        for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
            own, at = _places(terms.values.to_numpy().view(np.uint64), wanted)
            seen[own] += counts.values.to_numpy()[at]
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], ["term", "n"])


def _places(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two sorted arrays: which of ``wanted`` occur in ``have``, and where."""
    if not len(have):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    found = np.flatnonzero(have[at] == wanted)
    return found, at[found]


def intersect(postings: dict[int, np.ndarray], plan: list[tuple[int, int]], slop: int = 0) -> np.ndarray:
    """Starts of a window in a shard. ``plan``: its (term, offset) pairs, the rarest term first."""
    term, offset = plan[0]
    starts = postings[term] - offset if term in postings else np.empty(0, np.int32)
    for term, offset in plan[1:]:
        if not len(starts) or term not in postings:
            return starts[:0]
        there = postings[term]
        i = np.searchsorted(there, starts + (offset - slop))
        starts = starts[(i < len(there)) & (there[np.minimum(i, len(there) - 1)] <= starts + (offset + slop))]
    return starts


@dataclass
class Windows:
    """Windows of the items of a block, a row each: terms and their offsets from the rarest on, size, item."""

    terms: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(texts: list[tuple[int, np.ndarray]], seen: np.ndarray, window: int) -> Windows:
        """``seen``: how often the corpus has each term; windows with a term that it lacks are left out. Texts shorter than a window are one."""
        terms, sizes, items = [np.empty((0, window), np.int32)], [], []
        for item, text in texts:
            n = min(window, len(text))
            own = np.lib.stride_tricks.sliding_window_view(text, n)
            own = np.unique(own[(seen[own] > 0).all(1)], axis=0)
            terms.append(np.pad(own, ((0, 0), (0, window - n)), constant_values=-1))
            sizes += [n] * len(own)
            items += [item] * len(own)
        all_terms = np.concatenate(terms)
        rarity = np.where(all_terms < 0, np.iinfo(np.int64).max, seen[all_terms])
        offsets = np.argsort(rarity, axis=1, kind="stable").astype(np.int32)
        return Windows(np.take_along_axis(all_terms, offsets, 1), offsets, np.array(sizes, np.int64), np.array(items, np.int64))


def _search(batches: Iterator[pa.RecordBatch], sent, slop: int) -> Iterator[pa.RecordBatch]:
    """Per document with a match: row, ids of the matching items, and the hit runs as (start, end) pairs."""
    names, texts, wanted, seen, window = sent.value
    all_windows = Windows.of(texts, seen, window)
    for batch in batches:
        out: list[tuple[int, list[str], list[int]]] = []
        for rows, lengths, terms, counts, at in zip(*(batch.column(n) for n in ("rows", "lengths", "terms", "counts", "positions")), strict=True):
            own, place = _places(terms.values.to_numpy().view(np.uint64), wanted)
            present = np.zeros(len(wanted) + 1, bool)
            present[own] = True
            present[-1] = True  # the filler of short windows
            may = np.flatnonzero(present[all_windows.terms].all(1))
            if not len(may):
                continue
            lengths, at = lengths.values.to_numpy(), at.values.to_numpy()
            ends = np.concatenate(([0], np.cumsum(counts.values.to_numpy(), dtype=np.int64)))
            postings = {k: at[ends[p] : ends[p + 1]] for k, p in zip(own.tolist(), place.tolist(), strict=True)}
            starts = np.cumsum(np.append(0, lengths + 1))
            marks = np.zeros(starts[-1] + 1, np.int32)
            items: dict[int, set[int]] = {}
            for w in may.tolist():
                size, item = int(all_windows.sizes[w]), int(all_windows.items[w])
                s = intersect(postings, list(zip(all_windows.terms[w, :size].tolist(), all_windows.offsets[w, :size].tolist(), strict=True)), slop)
                if len(s):
                    d = np.searchsorted(starts, s, "right") - 1
                    inside = (s >= 0) & (d >= 0) & (s + size <= starts[np.minimum(d, len(lengths) - 1)] + lengths[np.minimum(d, len(lengths) - 1)])
                    s, d = s[inside], d[inside]
                    np.add.at(marks, s, 1)
                    np.add.at(marks, s + size, -1)
                    for k in set(d.tolist()):
                        items.setdefault(k, set()).add(item)
            hit = np.cumsum(marks[:-1]) > 0
            row_of = rows.values
            for k, found in items.items():
                own_hits = np.concatenate(([0], hit[starts[k] : starts[k] + lengths[k]].astype(np.int8), [0]))
                out.append((row_of[k].as_py(), sorted({names[i] for i in found}), np.flatnonzero(np.diff(own_hits)).tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], ["row", "items", "runs"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The positional index of all words of all documents, written to the shared folder; any number of benchmarks can be searched in it. A row for each shard."""
    id_field = docs.schema[id_col].dataType
    id_type = docs.limit(0).select(id_col).toArrow().schema.field(0).type
    rows = docs.select(docs[id_col].alias("id"), utf8(docs[text_col]).alias("text"), row_number(row_col).alias("row"))  # scanned once
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    index_type = T.StructType([T.StructField("rows", longs), T.StructField("ids", T.ArrayType(id_field)), T.StructField("lengths", ints), T.StructField("terms", longs), T.StructField("counts", ints), T.StructField("positions", ints)])
    return materialize(rows.mapInArrow(lean(lambda it: _shards(it, id_type)), index_type), "decontaminate-index", **LARGE_ROWS)


def search_index(index: DataFrame, items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of an index: row (its number), id, n_words, items (sorted ids of the items with a match), runs (bounds of the word runs that are hit)."""
    spark = index.sparkSession
    parts = []
    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        words = sorted({w for texts in block.values() for own in texts for w in own})
        keys = hashes(pa.array(words, pa.binary()))
        wanted = sorted_unique(keys)
        number = dict(zip(words, np.searchsorted(wanted, keys).tolist(), strict=True))
        asked = spark.sparkContext.broadcast(wanted)  # block_bytes at most
        seen = np.zeros(len(wanted) + 1, np.int64)
        frequency = index.select("terms", "counts").mapInArrow(lean(lambda it, asked=asked: _frequency(it, asked)), "term int, n long")
        for term, n in frequency.groupBy("term").agg(F.sum("n")).collect():  # a row for each term of the block
            seen[term] = n
        asked.unpersist()
        names = sorted(block)
        texts = [(k, np.array([number[w] for w in own], np.int32)) for k, name in enumerate(names) for own in block[name]]
        sent = spark.sparkContext.broadcast((names, texts, wanted, seen, window))  # block_bytes at most
        found = index.select("rows", "lengths", "terms", "counts", "positions").mapInArrow(lean(lambda it, sent=sent: _search(it, sent, slop)), "row long, items array<string>, runs array<int>")
        parts.append(materialize(found, "decontaminate-found"))
        sent.unpersist()
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:  # matches of a document in several blocks; as many rows as blocks at most
        places = lambda x, odd: F.filter(x, lambda _, i: i % 2 == odd)
        pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(places("runs", 0).alias("a"), places("runs", 1).alias("b")))))
        found = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), pairs.alias("pairs"))
        empty = F.array().cast("array<int>")
        # runs in the order of their starts: each begins a new one or prolongs the last
        joined = F.aggregate("pairs", empty, lambda out, p: F.when((F.size(out) > 0) & (F.element_at(out, -1) >= p["a"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(F.element_at(out, -1), p["b"])))).otherwise(F.concat(out, F.array(p["a"], p["b"]))))
        found = found.select("row", "items", joined.alias("runs"))
    every = index.select(F.explode(F.arrays_zip("rows", "ids", "lengths")).alias("x")).select(F.col("x.rows").alias("row"), F.col("x.ids").alias("id"), F.col("x.lengths").cast("long").alias("n_words"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return every.join(found, "row", "left").select("row", "id", "n_words", none("items", "array<string>"), none("runs", "array<int>"))


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, **options) -> DataFrame:
    """Index the documents and search them for the items: row, id, n_words, items, runs, as ``search_index``."""
    return search_index(build_index(docs, id_col, text_col, row_col), items, **options)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: row (its number), id, n_words, n_hit, n_items, items_sha256, contaminated."""
    id_col = options.get("id_col", "doc_id")
    found = phrase_matches(docs, items, **options)
    odd = F.filter("runs", lambda x, i: i % 2 == 1)
    even = F.filter("runs", lambda x, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    hit = total(odd) - total(even)
    return found.select("row", F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
