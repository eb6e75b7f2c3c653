"""Substring deduplication by sliding sentence spans.

A sentence ends after ``.``, ``!`` or ``?`` (or their wide forms) before white space, and at a line break. Text without sentence marks, or a passage that begins within a
sentence, would have no run of its own: so sentences of more than ``OVERLONG`` words are cut after words that their hash picks, which are the same wherever the words stand; what follows treats the clauses as sentences. Every run of ``SPAN_SENTENCES``
consecutive sentences is hashed. A run of under ``SPAN_WORDS`` words says too little by itself and is hashed with as many sentences more, after it and before it, as
reach that; a sentence of ``LONG_WORDS`` words is a run by itself. So any run of two or more sentences and ``SPAN_WORDS`` words that occurs again is covered whole, wherever it stands. Case and white space don't count.

Hashes have 128 bits: two polynomials over the 128-bit hashes of the sentences, so that at 10^12 spans a chance repeat has a probability of some 10^-14. They are counted over all documents. A span in several documents is first in the one with the least id, and at its
first place there; every sentence that any other occurrence covers goes. Rows that repeat an id count as one document. Of a document
only its distinct spans are sent, each once, and counts are added up before they are shuffled; a hot span is one row for each task and one
for each document that has it, and the join splits it. Null texts count as empty; null ids are never first unless no other row has the span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_has, filter_of, materialize, numbered, reclaim, sorted_unique

SPAN_SENTENCES = 2
SPAN_WORDS = 16
LONG_WORDS = 20
#: Sentences of more words are cut to clauses, after one word in ``CLAUSE``.
OVERLONG = 24
CLAUSE = 8
FILTER_BITS = 1 << 28
_BREAK = re.compile(r"[.!?。！？][^\S\n]+|\n\s*")
_WORD = re.compile(r"\s*(\S+)\s*")
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


class _Ends(dict):
    """Whether a word ends a clause of an overlong sentence: one word in ``CLAUSE`` does, by its MD5."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = found = hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[-1] % CLAUSE == 0
        return found


_ends = _Ends()


def sentences(text: str) -> list[str]:
    """Sentences, overlong ones cut to clauses, with the white space after them; together they are the text."""
    cuts = [m.end() for m in _BREAK.finditer(text)]
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        if b <= a:
            continue
        part = text[a:b]
        # white space other than blanks isn't printable; most parts are told short by their blanks
        if b - a > 2 * OVERLONG and (part.count(" ") >= OVERLONG or not part.isprintable()) and len(part.split()) > OVERLONG:
            at = 0
            for m in _WORD.finditer(part):
                if _ends[m[1].lower()] and m.end() < len(part):
                    out.append(part[at : m.end()])
                    at = m.end()
            out.append(part[at:])
        else:
            out.append(part)
    return out


def spans(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (a row of two halves), first sentence and end of each span."""
    words = [p.lower().split() for p in parts]
    n = len(parts)
    sizes = np.array([len(w) for w in words], np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    i = np.arange(n)
    ahead = np.maximum(np.searchsorted(upto, upto[:-1] + SPAN_WORDS), i + SPAN_SENTENCES)
    back = np.minimum(np.searchsorted(upto, upto[1:] - SPAN_WORDS, "right") - 1, i + 1 - SPAN_SENTENCES)
    long = np.flatnonzero(sizes >= LONG_WORDS)
    start = np.concatenate([i[ahead <= n], back[back >= 0], long])
    end = np.concatenate([ahead[ahead <= n], i[back >= 0] + 1, long + 1])
    if not len(start):
        return np.empty((0, 2), np.uint64), start, end
    both = sorted_unique(start * (n + 1) + end)
    start, end = both // (n + 1), both % (n + 1)
    digests = b"".join([xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words])
    halves = np.frombuffer(digests, np.uint64).reshape(n, 2)
    out = np.empty((len(start), 2), np.uint64)
    for k, factor in enumerate(_FACTORS):
        powers = np.cumprod(np.concatenate(([_U(1)], np.full(n, factor, np.uint64))))
        # a prefix sum of hash[k] * factor ** k, made independent of the place by factor ** (n - start)
        prefix = np.concatenate(([_U(0)], np.cumsum(halves[:, k] * powers[:n])))
        value = (prefix[end] - prefix[start]) * powers[n - start] * _inverse(n, factor) + (end - start).astype(np.uint64)
        value = (value ^ (value >> _U(31))) * _U(0xD6E8FEB86659FD93)
        out[:, k] = value ^ (value >> _U(29))
    return out, start, end


def _inverse(n: int, factor: int) -> np.uint64:
    """factor ** -n modulo 2 ** 64."""
    return _U(pow(pow(factor, -1, 1 << 64), n, 1 << 64))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct spans of each document with their first place, and bounds of the runs that later places cover."""
    ints = lambda x, t: pa.array([v.astype(np.int64) for v in x], pa.list_(t))
    for batch in batches:
        sizes, hashes, checks, starts, ends, again = [], [], [], [], [], []
        for t in batch.column("text"):
            parts = sentences(t.as_py() or "")
            sizes.append(len(parts))
            h, s, e = spans(parts)
            order = np.lexsort((s, h[:, 1], h[:, 0]))
            same = np.zeros(len(h), bool)
            same[1:] = (h[order[1:]] == h[order[:-1]]).all(1)
            first, later = np.sort(order[~same]), order[same]
            hashes.append(h[first, 0].view(np.int64))
            checks.append(h[first, 1].view(np.int64))
            starts.append(s[first])
            ends.append(e[first])
            again.append(np.stack([s[later], e[later]], 1).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(sizes, pa.int64()), ints(hashes, pa.int64()), ints(checks, pa.int64()), ints(starts, pa.int32()), ints(ends, pa.int32()), ints(again, pa.int32())], ["row", "id", "n", "spans", "checks", "starts", "ends", "again"])


def _likely(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """A row for each span that may occur in several documents."""
    for batch in batches:
        lists = batch.column("spans")
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy()
        some = np.flatnonzero(filter_has(sent.value, flat)) if len(flat) else np.empty(0, np.int64)
        at = pa.array(row[some])
        yield pa.RecordBatch.from_arrays([pa.array(flat[some]), batch.column("row").take(at), batch.column("id").take(at), *(batch.column(c).flatten().take(pa.array(some)) for c in ("checks", "starts", "ends"))], ["span", "row", "id", "check", "start", "end"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, words, out = [], [], []
        for t, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            text = t.as_py() or ""
            if not runs:
                gone.append(0)
                words.append(0)
                out.append(text)
                continue
            parts = sentences(text)
            cover = np.zeros(len(parts) + 1, np.int64)
            for a, b in zip(runs[::2], runs[1::2], strict=True):
                cover[a] += 1
                cover[b] -= 1
            covered = np.cumsum(cover[:-1]) > 0
            gone.append(int(covered.sum()))
            words.append(sum(len(p.split()) for p, c in zip(parts, covered.tolist(), strict=True) if c))
            out.append("".join(p for p, c in zip(parts, covered.tolist(), strict=True) if not c).strip() if gone[-1] else text)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *(pa.array(x, pa.int64()) for x in (gone, words)), pa.array(out, pa.string())], ["id", "n_sentences", "n_removed", "words_removed", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_sentences, n_removed (sentences), words_removed, text (what remains; as it was if nothing went). An empty table gives no rows; very long texts are one row like any other."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = numbered(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), "spans-docs")
    ints, longs = "array<int>", "array<long>"
    found = materialize(rows.select("row", "id", "text").mapInArrow(_emit, f"row long, id {id_type}, n long, spans {longs}, checks {longs}, starts {ints}, ends {ints}, again {ints}"), "spans")
    each = found.select("id", F.explode(F.arrays_zip("spans", "checks")).alias("x")).select("id", F.col("x.spans").alias("span"), F.col("x.checks").alias("check"))
    # equal ids count as one document: a span is repeated if its ids differ
    counted = each.groupBy("span", "check").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("known"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(counted.where("first <> last OR known < n AND n > 1").select("span", "check", "first"), "spans-repeated")
    reclaim(spark)
    sent = spark.sparkContext.broadcast(filter_of(repeated.select("span"), FILTER_BITS))
    likely = found.select("row", "id", "spans", "checks", "starts", "ends").mapInArrow(lambda it: _likely(it, sent), f"span long, row long, id {id_type}, check long, start int, end int")
    later = likely.join(repeated, ["span", "check"]).where(~F.col("id").eqNullSafe(F.col("first"))).select("row", F.array("start", "end").alias("run"))
    later = materialize(later.groupBy("row").agg(F.flatten(F.collect_list("run")).alias("runs")), "spans-later")  # at most a document's own spans
    sent.unpersist()
    reclaim(spark)
    runs = found.select("row", "n", "again").join(later, "row", "left").select("row", "n", F.concat(F.coalesce("runs", F.array().cast(ints)), "again").alias("runs"))
    cut = rows.join(runs, "row").select("id", "text", "n", "runs")
    return cut.mapInArrow(_remove, f"id {id_type}, n_sentences long, n_removed long, words_removed long, text string").withColumnRenamed("id", id_col)
