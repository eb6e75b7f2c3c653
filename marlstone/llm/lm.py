"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counting. The texts are written down once as tokens, in chunks of about a million words. Of each chunk the distinct words, pairs and triples
(hashes) with their counts in training texts are dealt by ranges of the hash space (parts); the owner of a part adds the
counts up, builds its filter and answers what the chunks ask of it. Counts are over all training texts. The hash space is gone through in ``SLICES`` slices one after the other, so that
the n-grams of a slice only, and not of all, are on disk at once.

Filter. A count c is quantised to the level 1 + floor(log_BASE c); level j of an n-gram is a member for each j up to
that. A level is read by repeated probes, until one fails. What a chunk asks is what it counts, so a filter is asked where it is built, and none leaves its task or passes through
the driver; meanwhile the questions wait in memory up to ``GROUP_BYTES``, then in a temporary file of the task. The answers meet the tokens
again by chunk. That takes time in proportion to the texts and is done alike at every size.

Model. Trigrams interpolated with pairs and words by absolute discounting:
P(w|h) = (r(c(h w)) + B(c(h)) P(w|h')) / (R(c(h)) + B(c(h))), with h' the shorter context and P(w) smoothed as the base score. r(c) = c - D(c), the discounts D for
1, 2 and more being those of modified Kneser-Ney smoothing, from the exact numbers of n-grams seen once to four times. B(c) = D(1) c^b is the expected weight
of the discounts of a context seen c times; b is such that the expected numbers of continuations of all contexts add up to the number of distinct
n-grams. R(c) is the most that r can add up to over the continuations of the context. n-grams
count as the least number of their level, contexts as the greatest, and an n-gram counts no more than the shorter ones in it; so for each
context the probabilities of all words add up to 1 at most, but for what false positives of the filter add (README has figures).

Base score. It needs exact counts: the most frequent words (``HEAD`` at most, by whole levels) are looked up in a broadcast table; of the others those that the filter has
meet their counts in a join. A word outside the table has at most some BASE / ``HEAD`` of all tokens, so no key of the join is hot.

Null and empty texts consist of the end token alone. Null ids hash like an empty text. Repeated rows each get their row, an empty table gives none; a very long text is a
chunk by itself. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, LARGE_ROWS, give_back, hashes, materialize, partitions, reclaim, scratch, utf8, word_numbers
from .langid import held_out

BASE = 1.5
#: Bits and probes for the first level of each n-gram, which says that it was seen at all, and for each level above, where an error only takes one count for the next.
#: A filter so filled errs at the first level for one unseen n-gram in about 80,000, and above for one in 40.
BITS, PROBES = 24, 12
UPPER_BITS, UPPER_PROBES = 9, 4
GROUP_BYTES = 32 << 20
HEAD = 1 << 20
#: Text whose n-grams make a part, about; an owner holds one at a time.
PART_TEXT = 64 << 20
#: Slices of the hash space that are dealt with one after the other.
SLICES = 2
#: Words of a chunk, about.
CHUNK = 1 << 20
LEVELS = 128
END = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0xD1B54A32D192ED03)
_U = np.uint64
_LEAST = np.concatenate(([0.0], np.ceil(BASE ** np.arange(LEVELS - 1.0) - 1e-9)))
_MOST = np.concatenate(([0.0], np.ceil(BASE ** np.arange(1.0, LEVELS) - 1e-9) - 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    return x ^ (x >> _U(29))


def gram_hash(before: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """Hash of an n-gram by that of the n-gram before it and its last word."""
    return _mix(before * _U(0xA0761D6478BD642F) ^ word + _U(order)) * _U(0xE7037ED1A0B428DB)


def _shifted(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """The value of the token before each, ``first`` at the start of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LEAST[1:], counts, "right")


def _pack(a: np.ndarray) -> bytes:
    """An array of small numbers by planes of bytes, compressed."""
    top = int(a.max(initial=0))
    a = np.ascontiguousarray(a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)))
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return pickle.dumps((a.dtype.str, len(a), pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)))


def _unpack(packed: bytes) -> np.ndarray:
    kind, n, data = pickle.loads(packed)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=_U(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    """Rows (without the last column, the text) and texts, in runs of about ``size`` words."""
    rows, texts, held = [], [], 0
    for batch in batches:
        for row, t in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), batch.column(batch.num_columns - 1), strict=True):
            t = t.as_py()
            rows.append(row)
            texts.append(t)
            held += len(t) // 6 + 1
            if held >= size:
                yield rows, texts
                rows, texts, held = [], [], 0
    if texts:
        yield rows, texts


@dataclass
class Chunk:
    """Some texts as tokens: ``words`` are the hashes of the distinct ones, the end token first; ``sizes`` the tokens of each text."""

    rows: list
    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(rows: list, texts: list[bytes]) -> Chunk:
        distinct, numbers, counts = word_numbers([t.lower() for t in texts])
        sizes = counts + 1
        tokens = np.zeros(int(sizes.sum()), np.int32)
        within = np.ones(len(tokens), bool)
        within[np.cumsum(sizes) - 1] = False
        tokens[within] = numbers + 1
        return Chunk(rows, np.concatenate(([END], hashes(distinct))), tokens, sizes)

    def packed(self) -> bytes:
        return pickle.dumps((self.rows, _pack(self.words), _pack(self.tokens), _pack(self.sizes)))

    @staticmethod
    def unpacked(data: bytes) -> Chunk:
        rows, words, tokens, sizes = pickle.loads(data)
        return Chunk(rows, _unpack(words), _unpack(tokens), _unpack(sizes).astype(np.int64))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def grams(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, of ``bits`` bits, of the pair and the triple that end with each token; texts begin with a start token, which follows the last pair."""
        starts, flat = self.starts, self.words[self.tokens]
        pair = gram_hash(_shifted(flat, starts, START), flat, 2)
        triple = gram_hash(_shifted(pair, starts, START), flat, 3)
        shift = _U(64 - bits)
        return np.append(pair, START) >> shift, triple >> shift


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each is a training one; the flag rides on the key through one sort."""
    both = np.sort(keys << _U(1) | train.astype(np.uint64))
    key = both >> _U(1)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    if not len(key):
        return key, first
    return key[first], np.add.reduceat((both & _U(1)).astype(np.int64), first)


_TOKENS = "chunk long, data binary"
_FRAGMENT = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for rows, texts in _texts(batches, CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([Chunk.of(rows, texts).packed()], pa.binary())], ["chunk", "data"])
        number += 1


def _cut(batches: Iterator[pa.RecordBatch], low: int, high: int, parts: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk, for each part from ``low`` to ``high``, the distinct words, pairs and triples that fall to it, in order, and their counts."""
    shift = _U(64 - bits)
    first, last = (_U(-(-k * (1 << 32) // parts) << 32 if k < parts else (1 << 64) - 1) for k in (low, high))
    edges = np.array([-(-k * (1 << 32) // parts) for k in range(low, high)][1:], np.uint64) << _U(32)

    def inside(keys: np.ndarray) -> np.ndarray:
        return (keys >= first) & (keys <= last if high == parts else keys < last)

    for batch in batches:
        for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
            chunk = Chunk.unpacked(data.as_py())
            train = np.repeat(np.array([not r[2] for r in chunk.rows]), chunk.sizes)
            used = np.bincount(chunk.tokens[train], minlength=len(chunk.words))
            own = np.flatnonzero(inside(chunk.words))
            own = own[np.argsort(chunk.words[own])]
            kinds = [(chunk.words[own], used[own])]
            for keys, flags in zip(chunk.grams(bits), (np.append(train, False), train), strict=True):
                some = inside(keys << shift)
                kinds.append(_counted(keys[some], flags[some]))
            start = START >> shift
            if inside(np.array([start << shift]))[0]:
                kinds[1][1][np.searchsorted(kinds[1][0], start)] += sum(not r[2] for r in chunk.rows)
            cuts = [np.concatenate(([0], np.searchsorted(k if i == 0 else k << shift, edges), [len(k)])) for i, (k, _) in enumerate(kinds)]
            datas, counts = [], []
            for p in range(high - low):
                piece = [(k[c[p] : c[p + 1]], n[c[p] : c[p + 1]]) for (k, n), c in zip(kinds, cuts, strict=True)]
                datas.append(pickle.dumps([_pack_sorted(k) for k, _ in piece]))
                counts.append(pickle.dumps([_pack(n) for _, n in piece]))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(datas), pa.int64()), pa.array(range(low, high), pa.int32()), pa.array(datas, pa.binary()), pa.array(counts, pa.binary())], _FRAGMENT.names)


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


class _Sums:
    """Counts of keys, added up whenever as much is waiting as is held."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting, self.held = [], [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        some = counts > 0
        self.keys.append(keys[some])
        self.counts.append(counts[some].astype(np.int64))
        self.waiting += len(self.keys[-1])
        if self.waiting > max(1 << 22, self.held):
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1 or self.waiting:
            k, c = _add(self.keys, self.counts) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
            self.keys, self.counts, self.waiting, self.held = [k], [c], 0, len(k)
        return self.keys[0], self.counts[0]


def _hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a key at a level; the probes step from the one by the other."""
    h = _mix(keys + _U(level * 0x8EBC6AF09C88C6E3 % (1 << 64)))
    return h, h * _U(0x589965CC75374CC3) | _U(1)


def _probes(level: int) -> int:
    return PROBES if level == 1 else UPPER_PROBES


#: Filters are made of blocks of 2 ** BLOCK bits. A key's place within its part picks the block, so sorted keys go through a filter from its start to its end; hashes pick the bits within.
BLOCK = 15
#: Keys that are looked up or entered at once.
_STRIDE = 1 << 14


def _block(keys: np.ndarray, part: int, parts: int, bits: int, blocks: int, width: int) -> np.ndarray:
    """First bit of each key's block, in a filter of so many blocks of 2 ** width bits."""
    place = (keys >> _U(bits - 40)) * _U(parts) - _U(part << 40)
    return (np.minimum(place >> _U(8), _U(0xFFFFFFFF)) * _U(blocks) >> _U(32)) << _U(width)


def build(keys: np.ndarray, level: np.ndarray, part: int, parts: int, bits: int, spread: int = 1) -> bytes:
    """Filter of a part's keys up to their levels; ``spread`` times as many bits as it needs make it err less."""
    total = max(1, int((level > 0).sum() * BITS + np.maximum(level.astype(np.int64) - 1, 0).sum() * UPPER_BITS) * spread)
    width = min(BLOCK, max(6, (total - 1).bit_length()))
    blocks = -(-total // (1 << width))
    found = np.zeros(blocks << width, np.uint8)
    base = _block(keys, part, parts, bits, blocks, width)
    for j in range(1, int(level.max(initial=0)) + 1):
        some = level >= j
        keys, level, base = keys[some], level[some], base[some]
        for a in range(0, len(keys), _STRIDE):
            bit, step = _hashed(keys[a : a + _STRIDE], j)
            for _ in range(_probes(j)):
                found[(bit >> _U(64 - width) | base[a : a + _STRIDE]).view(np.int64)] = 1
                bit += step
    return np.packbits(found, bitorder="little").tobytes()


#: Statistics of a part, by level: number and sum of words, of pairs, of triples; and numbers of pairs and triples seen once to four times.
_STATS = 6 * LEVELS + 10
_OWNED = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("data", T.BinaryType())]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("words", "counts", "stats")]
)


def _own(batches: Iterator[pa.RecordBatch], parts: int, bits: int, spread: int, group_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of each part that comes: as kind 1 the levels of what each chunk asks, and as kind 3 its words with exact counts and its statistics."""
    held: dict[int, tuple[list[_Sums], Asked]] = {}
    longs = pa.list_(pa.int64())
    shift = _U(64 - bits)
    for batch in batches:
        for part, number, data, counts in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data"), batch.column("counts"), strict=True):
            own, asked = held.setdefault(part, ([_Sums(), _Sums(), _Sums()], Asked(group_bytes)))
            asked.add(number, data.as_py())
            for sums, k, c in zip(own, pickle.loads(data.as_py()), pickle.loads(counts.as_py()), strict=True):
                sums.add(_unpack_sorted(k), _unpack(c))
    for part in list(held):
        own, asked = held.pop(part)
        sums = [s.sum() for s in own]
        level = [levels(c) for _, c in sums]
        stats = np.zeros(_STATS, np.int64)
        for i, (ls, (_, c)) in enumerate(zip(level, sums, strict=True)):
            stats[2 * i * LEVELS : (2 * i + 1) * LEVELS] = np.bincount(ls, minlength=LEVELS)
            stats[(2 * i + 1) * LEVELS : (2 * i + 2) * LEVELS] = np.bincount(ls, weights=c, minlength=LEVELS).astype(np.int64)
            if i:
                stats[6 * LEVELS + 5 * (i - 1) : 6 * LEVELS + 5 * i] = np.bincount(np.minimum(c, 5), minlength=6)[:5] if len(c) else 0
        words, n = sums[0]
        filled = Filter(parts, bits, {part: build(np.concatenate([words >> shift, sums[1][0], sums[2][0]]), np.concatenate(level), part, parts, bits, spread)})
        del own, sums, level
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([words.view(np.int64)], longs), pa.array([n], longs), pa.array([stats], longs)], _OWNED.names)
        for numbers, answers in _answers(asked, filled, part, bits):
            rows = len(numbers)
            yield pa.RecordBatch.from_arrays([pa.array([1] * rows, pa.int32()), pa.array([part] * rows, pa.int32()), pa.array(numbers, pa.int64()), pa.array(answers, pa.binary()), *(pa.nulls(rows, longs),) * 3], _OWNED.names)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the statistics of a task's parts."""
    out = np.zeros(_STATS, np.int64)
    for batch in batches:
        for stats in batch.column("stats"):
            out += stats.values.to_numpy()
    used = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], ["pos", "n"])


def _head(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of each part the words of at least that level, and their counts."""
    for batch in batches:
        for words, counts in zip(batch.column("words"), batch.column("counts"), strict=True):
            w, c = words.values.to_numpy().view(np.uint64), counts.values.to_numpy()
            some = levels(c) >= least
            yield pa.RecordBatch.from_arrays([pa.array([x[some].tobytes()], pa.binary()) for x in (w, c)], ["words", "counts"])


def head_of(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of at least that level, by hash, and their counts."""
    found = table.select("words", "counts").mapInArrow(lambda it: _head(it, least), "words binary, counts binary").collect()
    words, counts = (np.concatenate([np.frombuffer(bytes(h[k]), t) for h in found] or [np.empty(0, t)]) for k, t in (("words", np.uint64), ("counts", np.int64)))
    order = np.argsort(words)
    return words[order], counts[order]


@dataclass
class Filter:
    """Bloom filters of some parts."""

    parts: int
    bits: int
    own: dict[int, bytes]

    def level(self, keys: np.ndarray, part: int) -> np.ndarray:
        """Level of each key of a part, 0 where it isn't a member."""
        level = np.zeros(len(keys), np.uint8)
        if part not in self.own:
            return level
        words = np.frombuffer(self.own[part], np.uint64)
        width = min(BLOCK, len(words).bit_length() + 5)
        for a in range(0, len(keys), _STRIDE):
            some = keys[a : a + _STRIDE]
            self._levels(some, _block(some, part, self.parts, self.bits, len(words) << 6 >> width, width), words, width, level[a : a + _STRIDE])
        return level

    @staticmethod
    def _levels(keys: np.ndarray, base: np.ndarray, words: np.ndarray, width: int, out: np.ndarray) -> None:
        left, j = np.arange(len(keys)), 1
        while len(left):
            bit, step = _hashed(keys, j)
            held = None
            for p in range(_probes(j)):
                at = bit >> _U(64 - width) | base
                found = words.take((at >> _U(6)).view(np.int64)) >> (at & _U(63))
                held = found if held is None else held & found
                bit += step
                if p in (1, 4):  # most of those that aren't members are out by now
                    there = np.flatnonzero(held & _U(1))
                    if len(there) < 0.9 * len(left):
                        left, keys, base, bit, step, held = left[there], keys[there], base[there], bit[there], step[there], held[there]
            there = np.flatnonzero(held & _U(1))
            left, keys, base = left[there], keys[there], base[there]
            out[left] = j
            j += 1


class Asked:
    """What the chunks ask of a part; beyond ``most`` bytes it waits in a temporary file."""

    def __init__(self, most: int) -> None:
        self.chunks: list[tuple[int, int]] = []
        self.file = tempfile.SpooledTemporaryFile(max_size=most)  # noqa: SIM115  closed when all is read

    def add(self, chunk: int, data: bytes) -> None:
        self.chunks.append((chunk, len(data)))
        self.file.write(data)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        with self.file as f:
            f.seek(0)
            for chunk, size in self.chunks:
                yield chunk, f.read(size)


def _answers(asked: Asked, own: Filter, part: int, bits: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Chunks, and the levels of the words, pairs and triples that each asks a part for, in runs of about ``BATCH_BYTES``."""
    numbers, out, held = [], [], 0
    for number, data in asked:
        words, pairs, triples = map(_unpack_sorted, pickle.loads(data))
        numbers.append(number)
        out.append(pickle.dumps([_pack(own.level(k, part)) for k in (words >> _U(64 - bits), pairs, triples)]))
        held += len(out[-1])
        if held >= BATCH_BYTES:
            yield numbers, out
            numbers, out, held = [], [], 0
    if numbers:
        yield numbers, out


@dataclass
class Model:
    """What a score takes beside the levels; a row of ``left``, ``norm`` and ``back`` for pairs and one for triples, by level: r of an n-gram, R + B and B of a context."""

    head: np.ndarray  # hashes of the frequent words, sorted
    counts: np.ndarray
    space: float  # N + 0.5 (V + 1)
    left: np.ndarray
    norm: np.ndarray
    back: np.ndarray


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice and more often, by the numbers of those seen once to four times."""
    n1, n2, n3, n4 = seen
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate((d1, d2, d3), 1))


def spread_of(n: np.ndarray, total: np.ndarray, kinds: int) -> float:
    """The power b in [0, 1] by which contexts (``n`` of each level, seen ``total`` times in all) have count ** b continuations on average, ``kinds`` in all."""
    some = n > 0
    n, mean = n[some], total[some] / n[some]
    low, high = 0.0, 1.0
    for _ in range(50):
        b = (low + high) / 2
        low, high = (b, high) if (n * mean**b).sum() < kinds else (low, b)
    return low


def tables(seen: list[int], n: np.ndarray, total: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r of n-grams, R + B and B of contexts, by level."""
    d = np.array([0.0, *discounts(seen)])
    left = np.maximum(0, _LEAST - d[np.minimum(_LEAST, 3).astype(int)])
    share = np.maximum.accumulate(left / np.maximum(_LEAST, 1))
    back = np.where(_MOST > 0, d[1] * np.maximum(_MOST, 1) ** spread_of(n, total, kinds), 1.0)
    return left, _MOST * share + back, back


_SCORED = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"]


def _by_key(keys: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """Levels of keys, from those of the distinct ones in order."""
    order = np.argsort(keys)
    inorder = keys[order]
    rank = np.cumsum(np.concatenate(([0], inorder[1:] != inorder[:-1])))
    known = np.concatenate(found)
    if len(known) != rank[-1] + 1:
        raise ValueError("the answers aren't those of this chunk")
    out = np.empty(len(keys), np.uint8)
    out[order] = known[rank]
    return out


def _sums(chunk: Chunk, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, model: Model, id_type: pa.DataType) -> pa.RecordBatch:
    """Per text what its tokens add to both scores, but for the base score of rare words, which are listed. Levels: of the distinct words; of the pair of each token, and at the end of the start token; of triples."""
    starts, tokens, start = chunk.starts, chunk.tokens, pair[-1]
    own, pair = word[tokens], pair[:-1]
    c1, q1 = _LEAST[own], _MOST[before := _shifted(own, starts, start)]
    p1 = (c1 + 0.5) / model.space
    real = (own > 0) & (before > 0)
    pair = np.where(real, pair, 0)
    c2 = np.minimum(_LEAST[pair], np.minimum(c1, q1))
    level = lambda c: np.minimum(levels(c), LEVELS - 1)
    p2 = (model.left[0][level(c2)] + model.back[0][before] * p1) / model.norm[0][before]
    context = _shifted(pair, starts, start)
    c3 = np.where((pair > 0) & (context > 0), np.minimum(_LEAST[triple], np.minimum(c2, _MOST[context])), 0)
    p3 = (model.left[1][level(c3)] + model.back[1][context] * p2) / model.norm[1][context]
    at = np.minimum(np.searchsorted(model.head, chunk.words), max(0, len(model.head) - 1))
    frequent = model.head[at] == chunk.words if len(model.head) else np.zeros(len(chunk.words), bool)
    exact = np.where(frequent, model.counts[at] if len(model.head) else 0, 0)
    rare = ~frequent & (word > 0)
    term = np.where(rare, 0, np.log10((exact + 0.5) / model.space))
    some = np.flatnonzero(rare[tokens])
    cuts = np.append(np.searchsorted(some, starts), len(some)).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(cuts), pa.array(chunk.words[tokens[some]].view(np.int64)))
    row, ids, held = zip(*chunk.rows, strict=True)
    per_text = lambda x: np.add.reduceat(x, starts)  # noqa: E731  no text is without a token
    columns = [pa.array(row, pa.int64()), pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(chunk.sizes), pa.array(per_text(frequent[tokens].astype(np.int64))), pa.array(per_text(term[tokens])), pa.array(per_text(np.log10(p3))), listed]
    return pa.RecordBatch.from_arrays(columns, _SCORED)


def _join(batches: Iterator[pa.RecordBatch], sent, bits: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The tokens and answers of each chunk, which come together and in order, as scores."""
    model: Model = sent.value
    at, parts = None, []

    def close() -> pa.RecordBatch:
        chunk = Chunk.unpacked(parts[0])
        answers = [[_unpack(x) for x in pickle.loads(p)] for p in parts[1:]]
        pair, triple = chunk.grams(bits)
        return _sums(chunk, *(_by_key(k, [a[i] for a in answers]) for i, k in enumerate((chunk.words, pair, triple))), model, id_type)

    for batch in batches:
        for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
            if number != at:
                if parts:
                    yield close()
                at, parts = number, []
            parts.append(data.as_py())
    if parts:
        yield close()


def _slice(tokens: DataFrame, low: int, high: int, parts: int, bits: int, spread: int, group_bytes: int, path: str) -> None:
    """Counts the n-grams of some parts and writes the levels that the chunks ask for. The n-grams are deleted once they are used."""
    cut = tokens.mapInArrow(lambda it: _cut(it, low, high, parts, bits), _FRAGMENT)
    owned = cut.repartitionById(high - low, F.col("part") - low).mapInArrow(lambda it: _own(it, parts, bits, spread, group_bytes), _OWNED)
    owned.write.mode("append").option("compression", "uncompressed").options(**LARGE_ROWS).parquet(path)
    del cut, owned
    reclaim(tokens.sparkSession)


def score(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, head_words: int = HEAD, part_text: int = PART_TEXT, spread: int = 1) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``group_bytes``: questions to a part that its task holds in memory. ``spread``: times more bits for the filters."""
    spark = docs.sparkSession
    id_type = docs.limit(0).select(id_col).toArrow().schema.field(0).type
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col], folds).alias("held_out"), utf8(docs[text_col]).alias("text"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = materialize(rows, "lm-docs")  # a task that runs again must find the same chunks
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not n_docs:
        return rows.select(F.col("id").alias(id_col), "held_out", *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")), *(F.lit(0.0).alias(c) for c in ("base_score", "score")))
    parts = max(partitions(spark), -(-n_bytes // (SLICES * part_text))) * SLICES
    bits = min(56, max(40, int(n_bytes // 4).bit_length() + 9))  # one n-gram in 512, at most, shares its hash
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    tokens = materialize(numbered.mapInArrow(_tokenize, _TOKENS), "lm-tokens", **LARGE_ROWS)
    path = scratch(spark, "lm-parts")
    for part in range(0, parts, parts // SLICES):
        _slice(tokens, part, part + parts // SLICES, parts, bits, spread, group_bytes, path)
    written = spark.read.schema(_OWNED).parquet(path)
    table = written.where("kind = 3")
    stats = np.zeros(_STATS)
    for k, n in table.select("stats").mapInArrow(_total, "pos int, n long").groupBy("pos").agg(F.sum("n")).collect():  # a row for each statistic
        stats[k] = n
    words_n, words_sum, pairs_n, pairs_sum, triples_n, _ = stats[: 6 * LEVELS].reshape(6, LEVELS)
    space = words_sum.sum() + 0.5 * (words_n.sum() + 1)
    more = np.cumsum(words_n[::-1])[::-1]  # words of a level or above
    least = next((k for k in range(1, LEVELS) if more[k] <= head_words), LEVELS)
    head, counts = head_of(table, least)  # head_words words at most
    both = [
        tables(stats[6 * LEVELS + 1 : 6 * LEVELS + 5].tolist(), words_n, words_sum, pairs_n.sum()),
        tables(stats[6 * LEVELS + 6 :].tolist(), pairs_n, pairs_sum, triples_n.sum()),
    ]
    model = Model(head, counts, float(space), *(np.stack(x) for x in zip(*both, strict=True)))

    sent = spark.sparkContext.broadcast(model)
    scored_type = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())]
        + [T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType()))]
    )
    together = tokens.select("chunk", F.lit(-1).alias("part"), "data").unionByName(written.where("kind = 1").select("chunk", "part", "data"))
    together = together.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "part").select("chunk", "data")
    scored = materialize(together.mapInArrow(lambda it: _join(it, sent, bits, id_type), scored_type), "lm-scored")
    sent.unpersist()
    reclaim(spark)
    rare = table.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("c")).where(F.col("c") < float(_LEAST[least] if least < LEVELS else np.inf))
    c = F.coalesce("c", F.lit(0))
    needed = scored.select("row", F.explode("rare").alias("word"))
    added = needed.join(rare, "word", "left").groupBy("row").agg(F.sum(F.log10((c + 0.5) / F.lit(float(space)))).alias("base2"), F.sum(F.when(c > 0, 1)).alias("known2"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    joined = scored.drop("rare").join(added, "row", "left")
    return joined.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("n_known", "known2").alias("n_known"), F.lit(int(words_sum.sum())).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), "score")
