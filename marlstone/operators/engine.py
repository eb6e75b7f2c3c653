"""A dataset behind a handle: queries, pages, aggregations, caches, indexes, metrics."""

from __future__ import annotations

import json
import math
import re
import time
from collections import OrderedDict, deque
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions import bm25
from ..functions.text import ascii_lower, fold
from ..functions.values import Flags, Variant
from ..plans.lexer import normalize
from ..plans.syntax import Many, Node, Predicate, Query, QueryError
from ..sources import records as io
from . import search as s
from .aggregate import aggregate
from .search import ROW_ID, Dataset

#: Fields that are indexed unless others are named; sizes of the result cache and of the latency window.
DEFAULT_INDEXES = ("category", "country", "active")
CACHE_SIZE, CACHE_MIN_HITS, WINDOW, SLOW_MS = 128, 2, 200, 50.0
#: An index narrows a query if it leaves at most so many rows; their numbers are broadcast.
CANDIDATES = 100_000


class HandleError(KeyError):
    def __init__(self) -> None:
        super().__init__("Invalid engine handle")


@dataclass(frozen=True)
class Options:
    indexes: tuple[str, ...] = ()
    query_cache_cap: int = CACHE_SIZE
    #: Keep the data in Spark's columnar cache, with statistics by which blocks are skipped. It holds all fields, so ``columnar_fields`` needs no more.
    columnar: bool = False
    columnar_fields: tuple[str, ...] = ()


class ResultCache:
    """Results asked for ``min_hits`` times are persisted; beyond the capacity the one used longest ago is dropped."""

    def __init__(self, capacity: int, min_hits: int = CACHE_MIN_HITS) -> None:
        self.capacity, self.min_hits = max(1, capacity), min_hits
        self.asked: OrderedDict[str, int] = OrderedDict()
        self.held: OrderedDict[str, DataFrame] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str) -> DataFrame | None:
        found = self.held.get(key)
        self.hits += found is not None
        self.misses += found is None
        if found is not None:
            self.held.move_to_end(key)
        return found

    def record(self, key: str, df: DataFrame) -> DataFrame:
        self.asked[key] = self.asked.pop(key, 0) + 1
        while len(self.asked) > 8 * self.capacity:
            self.asked.popitem(last=False)
        if self.asked[key] < self.min_hits:
            return df
        self.held[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)[1].unpersist()
        return df

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()
        self.asked.clear()

    def stats(self) -> dict:
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.held), "cap": self.capacity}


@dataclass
class Metrics:
    queries: int = 0
    total_ms: float = 0.0
    rows: int = 0
    recent: deque = field(default_factory=lambda: deque(maxlen=WINDOW))

    def record(self, ms: float, rows: int) -> None:
        self.queries += 1
        self.total_ms += ms
        self.rows += rows
        self.recent.append(ms)

    def p95(self) -> float:
        ranked = sorted(self.recent)
        return ranked[math.ceil(len(ranked) * 0.95) - 1] if ranked else 0.0


class Engine:
    def __init__(self, data: Dataset, options: Options | None = None) -> None:
        self.options = options or Options()
        self.data = self._held(data)
        self.indexes = list(dict.fromkeys(self.options.indexes or DEFAULT_INDEXES))
        self.cache = ResultCache(self.options.query_cache_cap)
        self.metrics = Metrics()
        self._tokens: DataFrame | None = None
        self._postings: dict[str, DataFrame] = {}
        self._size: int | None = None

    def _held(self, data: Dataset) -> Dataset:
        """The data, or with the option ``columnar`` its columnar copy, filled by the first query and kept until the data changes."""
        if not self.options.columnar:
            return data
        return replace(data, df=data.df.select("*").persist(StorageLevel.MEMORY_AND_DISK))

    # queries

    def query(self, text: str) -> DataFrame:
        """Rows of a query; lazily, but from the cache if it was asked often enough. Nothing runs here, so the metrics don't count it: ``execute``, ``query_json`` and ``page`` do."""
        return self._cached(text, "query", self._search)

    def _search(self, query: Query) -> DataFrame:
        return s.search(self._narrowed(query), query, self._ranked(query))

    def execute(self, text: str) -> list:
        """Rows of a query as objects, run and measured."""
        return [json.loads(r) for r in self._run(text)]

    def query_json(self, text: str) -> str:
        """Rows as a JSON array, run and measured."""
        return "[" + ",".join(self._run(text)) + "]"

    def _run(self, text: str) -> list[str]:
        started, hits = time.perf_counter(), self.cache.hits
        df = self._cached(text, "query", self._search)
        rows = [r["json"] for r in s.json_rows(self.data, df).select("json").collect()]
        self._note(started, 0 if self.cache.hits > hits else self._rows())
        return rows

    def _rows(self) -> int:
        """Rows of the data; a scan reads them all."""
        if self._size is None:
            self._size = self.data.df.count()
        return self._size

    def row_ids(self, text: str) -> DataFrame:
        return self._cached(text, "ids", lambda q: s.row_ids(self.data, q))

    def page(self, text: str) -> tuple[int, DataFrame]:
        """Number of all matches, and the rows that OFFSET and LIMIT leave. The page is a top-k, the count a filtered scan; neither sorts all."""
        started = time.perf_counter()
        query = self.data.parse(text)
        whole = replace(query, limit=None, offset=0, order=(), select=None)
        everything = self._cached(repr(whole), "matches", lambda _: s.matched(self.data, whole)[0], whole)
        total = everything.count()
        self._note(started, self._rows())
        return total, self._search(query)

    def page_json(self, text: str) -> dict:
        total, rows = self.page(text)
        return {"total_matches": total, "rows": [r["json"] for r in s.json_rows(self.data, rows).select("json").collect()]}

    def aggregate(self, spec: str | dict, shared_state: bool = False) -> DataFrame:
        return aggregate(self.data, spec, shared_state)

    def _cached(self, text: str, kind: str, run, query=None) -> DataFrame:
        key = f"{kind} {normalize(text)}"
        found = self.cache.get(key)
        return found if found is not None else self.cache.record(key, run(query or self.data.parse(text)))

    def _ranked(self, query) -> DataFrame | None:
        """Tokens of all records, made by the first query that ranks and kept until the data changes."""
        if query.needs_score and self._tokens is None:
            self._tokens = bm25.with_tokens(self.data.df, self.data.records, s._TOKENS).persist(StorageLevel.MEMORY_AND_DISK)
        return self._tokens if query.needs_score else None

    def _note(self, started: float, rows: int) -> None:
        self.metrics.record((time.perf_counter() - started) * 1000, rows)
        if self.metrics.p95() > SLOW_MS:
            self.cache.min_hits = 1

    # indexes in queries

    def _narrowed(self, query: Query) -> Dataset:
        """The data, or in a strict query without regard to case only the rows that an index leaves, if these are few. The condition is applied to them all the same."""
        if query.case_sensitive or not query.strict or query.needs_score or ROW_ID not in self.data.df.columns:
            return self.data
        parts = query.where.parts if isinstance(query.where, Many) and query.where.kind == "and" else (query.where,)
        for p in parts:
            keys = self._keys(p)
            if keys is None:
                continue
            rows = self.postings(p.path).where(F.col("key").isin(keys)).select(ROW_ID).distinct()
            if len(rows.limit(CANDIDATES + 1).take(CANDIDATES + 1)) <= CANDIDATES:
                return replace(self.data, df=self.data.df.join(F.broadcast(rows), ROW_ID, "left_semi"))  # CANDIDATES numbers at most
        return self.data

    def _keys(self, node: Node) -> list[str] | None:
        """Keys of an equality or a list over an indexed field; None if the index can't answer it."""
        if not isinstance(node, Predicate) or node.op not in ("=", "IN") or node.path not in self.indexes or not node.values:
            return None
        keys = []
        for v in node.values:
            if isinstance(v, bool):
                keys.append(f"b:{str(v).lower()}")
            elif isinstance(v, float):
                keys.append("n:" + self.data.df.sparkSession.range(1).select(F.lit(v).cast("double").cast("string")).first()[0])
            elif isinstance(v, str):
                keys.append("s:" + ascii_lower(v))
            else:
                return None
        return keys

    def postings(self, path: str) -> DataFrame:
        """The index of a field, made by the first query that uses it, in the order of its keys so that a lookup reads few blocks, and kept until the data changes."""
        if path not in self._postings:
            self._postings[path] = self.index(path).repartitionByRange("key").sortWithinPartitions("key").persist(StorageLevel.MEMORY_AND_DISK)
        return self._postings[path]

    # data

    def update(self, data: Dataset) -> None:
        """Other data under the same options; caches, tokens and metrics start again."""
        self.close()
        self.data, self.metrics = self._held(data), Metrics()
        self.cache = ResultCache(self.options.query_cache_cap)

    def close(self) -> None:
        self.cache.clear()
        if self._tokens is not None:
            self._tokens.unpersist()
            self._tokens = None
        if self.options.columnar:
            self.data.df.unpersist()
        for held in self._postings.values():
            held.unpersist()
        self._postings.clear()
        self._size = None

    def data_size(self) -> dict:
        """Rows, and bytes of their JSON text."""
        row = s.json_rows(self.data, self.data.df).agg(F.count(F.lit(1)), F.sum(F.octet_length("json"))).first()
        return {"row_count": row[0], "approx_bytes": row[1] or 0}

    # indexes

    def create_index(self, path: str) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.]+", path):
            raise QueryError("Invalid field name", 0)
        if path not in self.indexes:
            self.indexes.append(path)

    def drop_index(self, path: str) -> None:
        if path in self.indexes:
            self.indexes.remove(path)
        if held := self._postings.pop(path, None):
            held.unpersist()

    def index(self, path: str) -> DataFrame:
        """Postings: key (typed, ASCII lower case) and row number; an array is one entry for each element. Objects and nulls have none."""
        value = self.data.records.value(path, Flags())
        ids = F.col(ROW_ID) if ROW_ID in self.data.df.columns else F.monotonically_increasing_id()
        if isinstance(value, Variant):
            items = F.coalesce(value.column.try_cast("array<variant>"), F.array(value.column))
            each = self.data.df.select(ids.alias(ROW_ID), F.explode(items).alias("v"))
            v = Variant(F.col("v"), Flags())
            kind = v.kind
            key = F.when(kind == "STRING", F.concat(F.lit("s:"), fold(v.text()))).when(kind == "BOOLEAN", F.concat(F.lit("b:"), v.truth().cast("string"))).when(v.number().isNotNull(), F.concat(F.lit("n:"), v.number().cast("string")))
        elif hasattr(value, "column"):
            is_array = isinstance(value.kind, T.ArrayType)
            each = self.data.df.select(ids.alias(ROW_ID), (F.explode(value.column) if is_array else value.column).alias("v"))
            kind = value.kind.elementType if is_array else value.kind
            text = isinstance(kind, T.StringType)
            mark = "s:" if text else "b:" if isinstance(kind, T.BooleanType) else "n:"
            key = F.concat(F.lit(mark), fold(F.col("v")) if text else F.col("v").cast("string") if mark == "b:" else F.col("v").cast("double").cast("string"))
        else:
            return self.data.df.select(F.lit(None).cast("string").alias("key"), ids.alias(ROW_ID)).limit(0)
        return each.select(key.alias("key"), ROW_ID).where(F.col("key").isNotNull())

    def list_indexes(self) -> DataFrame:
        """field, keys (distinct) and entries of each index, in one row each."""
        parts = [self.index(p).agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("entries")).select(F.lit(p).alias("field"), "keys", "entries") for p in self.indexes]
        out = parts[0] if parts else self.data.df.sparkSession.createDataFrame([], "field string, keys long, entries long")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # introspection

    def cache_stats(self) -> dict:
        return self.cache.stats()

    def get_metrics(self) -> dict:
        m, asked = self.metrics, self.cache.hits + self.cache.misses
        return {"query_count": m.queries, "avg_latency_ms": m.total_ms / m.queries if m.queries else 0.0, "p95_latency_ms": m.p95(), "rows_scanned": m.rows, "cache_hit_rate": self.cache.hits / asked if asked else 0.0}


class Registry:
    """Engines by handle; handles count from 1."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.engines, self._next = spark, {}, count(1)

    def open(self, data: Dataset, options: Options | None = None) -> int:
        handle = next(self._next)
        self.engines[handle] = Engine(data, options)
        return handle

    def init_engine(self, items_json: str) -> int:
        return self.open(io.from_json_array(self.spark, items_json))

    def init_engine_with_indexes(self, items_json: str, fields: list[str]) -> int:
        return self.open(io.from_json_array(self.spark, items_json), Options(tuple(fields)))

    def init_engine_with_options(self, items_json: str, options: dict) -> int:
        return self.open(io.from_json_array(self.spark, items_json), _options(options))

    def init_engine_from_bytes(self, data: bytes, options: dict | None = None) -> int:
        return self.open(io.from_bytes(self.spark, data), _options(options or {}))

    def init_engine_from_gzip(self, data: bytes, options: dict | None = None) -> int:
        return self.open(io.from_gzip(self.spark, data), _options(options or {}))

    def __getitem__(self, handle: int) -> Engine:
        if handle not in self.engines:
            raise HandleError
        return self.engines[handle]

    def update_engine(self, handle: int, items_json: str) -> None:
        engine = self[handle]
        engine.update(io.from_json_array(self.spark, items_json))

    def drop_engine(self, handle: int) -> None:
        """Unknown handles are no error."""
        if engine := self.engines.pop(handle, None):
            engine.close()


def _options(options: dict) -> Options:
    if not isinstance(options, dict) or not all(isinstance(options.get(k, []), list) for k in ("indexes", "columnar_fields")):
        raise ValueError("Invalid options JSON")
    return Options(tuple(options.get("indexes", ())), int(options.get("query_cache_cap", CACHE_SIZE)), bool(options.get("columnar")), tuple(options.get("columnar_fields", ())))


# one-shot forms and helpers of a client


def search_json(spark: SparkSession, items: list, text: str) -> list[str]:
    """Rows of a query over Python objects, as JSON texts."""
    data = io.from_objects(spark, items)
    return [r["json"] for r in s.json_rows(data, s.search(data, text)).select("json").collect()]


def search_objects(spark: SparkSession, items: list, text: str) -> list:
    """Rows of a query over Python objects, as Python objects."""
    return [json.loads(r) for r in search_json(spark, items, text)]


def execute_query_json(spark: SparkSession, items_json: str, text: str) -> str:
    data = io.from_json_array(spark, items_json)
    return io.to_json_array(data, s.search(data, text))


def aggregate_json(spark: SparkSession, items: list, spec: str | dict) -> DataFrame:
    return aggregate(io.from_objects(spark, items), spec)


def page_query(base: str, page: int, size: int = 25) -> str:
    """The query for a page, counted from 1."""
    return f"{base.strip()} LIMIT {size} OFFSET {(max(1, page) - 1) * size}".strip()


def count_by(path: str, base: str | None = None) -> dict:
    """Specification: rows by field, of a base query's matches."""
    return {"group_by": [path], "aggs": [{"op": "COUNT", "field": "*", "alias": "count"}]} | ({"filter": base} if base else {})


def average_by(value: str, path: str, base: str | None = None) -> dict:
    return {"group_by": [path], "aggs": [{"op": "AVG", "field": value, "alias": "avg"}]} | ({"filter": base} if base else {})
