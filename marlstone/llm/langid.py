"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points, lower-cased, everything but letters turned into a space and runs of spaces into one. All 1-, 2-
and 3-grams are hashed into buckets; the matrix of their log-probabilities per language goes to the workers (``CELLS``
values at most) and batches are scored by summing its rows. The matrix is fitted on a bounded sample of labelled rows,
``FIT_DOCS`` in all and an equal share for each language, chosen by a hash of id and text, so that null or equal ids neither empty nor swell it; whole texts are read always.

Null texts and texts without a letter are ``und`` with score 0; so is everything if no row is labelled. Null ids hash like
an empty text. Repeated rows each get their row, an empty table none; very long texts are scored in pieces whose sums are added. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spread import spread
from .common import lean

FIT_DOCS = 16_000
CELLS = 1 << 22
ORDERS = 3
UNKNOWN = "und"
_CHUNK = 1 << 18
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@cache
def _folded() -> np.ndarray:
    """Lower-case letter, or a space, for each code point of the basic plane."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = np.where(c < 1 << 16, _folded()[np.minimum(c, 65535)], c)
    space = c == 32
    return c[np.concatenate(([True], ~(space[1:] & space[:-1])))] if len(c) else c


def _grams(codes: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that begin at each code point but the last two, by order."""
    n = len(codes) - ORDERS + 1
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    h = np.zeros(n, np.uint32)
    for k in range(ORDERS):
        h = (h ^ codes[k : k + n]) * _MULTIPLIERS[k]
        yield (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> shift


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after a space and before two; bounds of the texts."""
    parts, starts, ends, at = [], [], [], 0
    for t in texts:
        c = _codes(t)
        parts += [np.array([32], np.uint32), c, np.array([32, 32], np.uint32)]
        starts.append(at)
        ends.append(at + len(c) + 1)
        at += len(c) + 3
    return np.concatenate(parts), np.array(starts), np.array(ends)


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang, text in zip(langs, batch.column("text"), strict=True):
            own = sums.setdefault(lang, np.zeros(buckets, np.int64))
            flat, _, (end,) = _flat([text.as_py()])
            for a in range(0, end, _CHUNK):
                for g in _grams(flat[a : min(end, a + _CHUNK) + ORDERS - 1], buckets):
                    own += np.bincount(g, minlength=buckets)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"])


def letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(id_column: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == 1


def fit(docs: DataFrame, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, cells: int = CELLS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities: a row for each bucket and one for the prior."""
    ident, text, lang = docs[id_col], docs[text_col], docs[lang_col].cast("string")
    usable = docs.where(lang.isNotNull() & ~held_out(ident, folds))
    sizes = dict(usable.groupBy(lang.alias("lang")).count().collect())  # one row per language
    if not sizes:
        return [], np.zeros((2, 0))
    buckets = 1 << max(8, min(16, (cells // len(sizes)).bit_length() - 1))
    each = max(1, fit_docs // len(sizes))
    share = F.element_at(F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, each / v)))), lang)
    luck = F.pmod(F.xxhash64(F.coalesce(ident.cast("string"), F.lit("")), text, F.lit("fit")), F.lit(1 << 20))
    sample = usable.where((luck < share * (1 << 20)) & text.isNotNull()).select(lang.alias("lang"), text.alias("text")).repartition(8)  # bounded by fit_docs
    totals: dict[str, np.ndarray] = {}
    for key, counts in sample.mapInArrow(lean(lambda it: _count(it, buckets)), "lang string, counts binary").collect():  # 8 rows a language at most
        totals[key] = totals.get(key, 0) + np.frombuffer(bytes(counts), np.int64)
    langs = sorted(totals)
    if not langs:
        return [], np.zeros((2, 0))
    counts = np.stack([totals[k] for k in langs], 1) + 0.5
    priors = np.log(np.array([[sizes[k] for k in langs]]) / sum(sizes[k] for k in langs))
    return langs, np.vstack([np.log(counts / counts.sum(0)), np.zeros((1, len(langs))), priors])


def posterior(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log-probabilities up to a constant, a row for each text."""
    buckets, width = len(matrix) - 2, matrix.shape[1]
    flat, starts, ends = _flat(texts)
    sums = np.zeros((len(texts), width))
    chunk = max(1024, _CHUNK * 4 // max(4, width))
    inside = np.zeros(len(flat) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    for a in range(0, len(flat) - ORDERS + 1, chunk):
        seg = flat[a : a + chunk + ORDERS - 1]
        b = a + len(seg) - ORDERS + 1
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        cuts = np.maximum(starts[first:last], a) - a
        for g in _grams(seg, buckets):
            rows = matrix[np.where(inside[a:b], g, buckets)]
            sums[first:last] += np.add.reduceat(rows, cuts, 0)
    return sums + matrix[-1]


def _predict(batches: Iterator[pa.RecordBatch], model, extra: int) -> Iterator[pa.RecordBatch]:
    langs, matrix = model.value
    for batch in batches:
        n, clear = batch.num_rows, batch.column(extra + 1).to_pylist()
        lang, score = [UNKNOWN] * n, [0.0] * n
        todo = [i for i in range(n) if clear[i]] if langs else []
        for k in range(0, len(todo), 512):
            part = todo[k : k + 512]
            p = posterior([batch.column(extra)[i].as_py() for i in part], matrix)
            p -= p.max(1, keepdims=True)
            best = p.argmax(1)
            sure = 1 / np.exp(p).sum(1)
            for i, b, s in zip(part, best.tolist(), sure.tolist(), strict=True):
                lang[i], score[i] = langs[b], s
        yield pa.RecordBatch.from_arrays([*batch.columns[:extra], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:extra], "lang_pred", "score"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` (by name) of each row, lang_pred and score."""
    text, extra = docs[text_col].cast("string"), len(keep or {})
    kept = spread(docs).select(*(c.alias(k) for k, c in (keep or {}).items()), text.alias("text of the row"), letters(text).alias("has letters"))
    schema = T.StructType([*kept.schema.fields[:extra], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept.mapInArrow(lean(lambda it: _predict(it, sent, extra)), schema)
