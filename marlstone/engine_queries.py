"""Registered queries of what stands around the language: sources, sinks, VARIANT records, engine handles, caches, indexes; each with its DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.text import POSIX
from .operators import engine as E
from .operators.aggregate import SpecError, aggregate
from .operators.search import ROW_ID, Dataset, search
from .plans.lexer import normalize
from .plans.parser import QueryCache, validate_query
from .sources import records as io

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}
#: Tables of a few rows whatever the scale, which a driver may hold as JSON.
NATION = ("n_nationkey", "n_name", "n_regionkey")


def registered(sql: str) -> Callable[[Run], Run]:
    """Registers a query under its function's name."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__], ORACLE_SQL[run.__name__] = run, sql
        return run

    return add


def _folded(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _variant(df: DataFrame, **options) -> Dataset:
    """A table's rows as JSON records in VARIANT."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(io.RAW))
    return Dataset(rows.withColumn(io.RECORD, F.parse_json(io.RAW)), io.RECORD, io.RAW, **options)


def _fields(df: DataFrame, **fields: str) -> DataFrame:
    """Fields of VARIANT records as columns."""
    return df.select(*(F.variant_get(io.RECORD, f"$.{k}", t).alias(k) for k, t in fields.items()))


def _json(spark: SparkSession, sf_dir: str, name: str = "nation") -> str:
    """A small table as the text of a JSON array."""
    d = Dataset(_table(spark, sf_dir, name))
    return io.to_json_array(d, d.df)


def _nations(rows: DataFrame) -> DataFrame:
    return _fields(rows, n_nationkey="bigint", n_name="string")


def _rows_of(spark: SparkSession, texts: list) -> DataFrame:
    """Nations of objects, or of their JSON texts."""
    items = [json.loads(t) if isinstance(t, str) else t for t in texts]
    return spark.createDataFrame([(x["n_nationkey"], x["n_name"]) for x in items], "n_nationkey long, n_name string")


_ASKED = "n_regionkey = 2 OR n_name STARTS WITH \"c\""
_WANTED = f"SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey = 2 OR starts_with({_folded('n_name')}, 'c')"


# sources and sinks


@registered(_WANTED)
def source_json_string(spark, sf_dir):
    return _nations(search(io.from_json_array(spark, _json(spark, sf_dir)), _ASKED))


@registered(_WANTED)
def source_json_with_indexes(spark, sf_dir):
    registry = E.Registry(spark)
    return _nations(registry[registry.init_engine_with_indexes(_json(spark, sf_dir), ["n_regionkey"])].query(_ASKED))


@registered(_WANTED)
def source_json_with_options(spark, sf_dir):
    registry = E.Registry(spark)
    handle = registry.init_engine_with_options(_json(spark, sf_dir), {"indexes": ["n_name"], "columnar": True, "columnar_fields": ["n_regionkey"], "query_cache_cap": 3})
    return _nations(registry[handle].query(_ASKED))


@registered(_WANTED)
def source_utf8_bytes(spark, sf_dir):
    registry = E.Registry(spark)
    return _nations(registry[registry.init_engine_from_bytes(_json(spark, sf_dir).encode())].query(_ASKED))


@registered(_WANTED)
def source_gzip_bytes(spark, sf_dir):
    registry = E.Registry(spark)
    return _nations(registry[registry.init_engine_from_gzip(io.gzip_compress_bytes(_json(spark, sf_dir).encode()))].query(_ASKED))


@registered(_WANTED)
def source_objects(spark, sf_dir):
    return _rows_of(spark, E.search_objects(spark, json.loads(_json(spark, sf_dir)), _ASKED))


@registered(_WANTED)
def one_shot_json_rows(spark, sf_dir):
    return _rows_of(spark, E.search_json(spark, json.loads(_json(spark, sf_dir)), _ASKED))


@registered(_WANTED)
def one_shot_json_text(spark, sf_dir):
    return _rows_of(spark, json.loads(E.execute_query_json(spark, _json(spark, sf_dir), _ASKED)))


@registered(_WANTED)
def engine_execute(spark, sf_dir):
    return _rows_of(spark, E.Engine(io.from_json_array(spark, _json(spark, sf_dir))).execute(_ASKED))


@registered(_WANTED)
def sink_json_array(spark, sf_dir):
    return _rows_of(spark, json.loads(E.Engine(io.from_json_array(spark, _json(spark, sf_dir))).query_json(_ASKED)))


@registered("SELECT doc_id, strlen(text)::BIGINT AS n_bytes FROM documents")
def gzip_bytes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))

    def there_and_back(batches):
        import pyarrow as pa

        for b in batches:
            again = [io.gzip_decompress_bytes(io.gzip_compress_bytes(x.as_py())) for x in b.column("data")]
            if again != b.column("data").to_pylist():
                raise ValueError("other bytes came back")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in again], pa.int64())], ["doc_id", "n_bytes"])

    return docs.mapInArrow(there_and_back, "doc_id long, n_bytes long")


@registered("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 10")
def json_lines_column(spark, sf_dir):
    """Records of a column of JSON texts, as JSON lines are read, at any size."""
    found = search(_variant(_table(spark, sf_dir, "events")), 'event_type = "click" AND value > 10')
    return _fields(found, event_id="bigint", user_id="bigint")


# handles


@registered("SELECT 'region' AS what, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'dropped', 1")
def engine_update_and_drop(spark, sf_dir):
    registry = E.Registry(spark)
    handle = registry.init_engine(_json(spark, sf_dir, "region"))
    out = [("region", registry[handle].query("").count())]
    registry.update_engine(handle, _json(spark, sf_dir))
    out.append(("nation", registry[handle].query("n_regionkey = 1").count()))
    registry.drop_engine(handle)
    try:
        registry[handle]
    except E.HandleError:
        out.append(("dropped", 1))
    return spark.createDataFrame(out, "what string, n long")


@registered("SELECT 1::BIGINT AS hits, 3::BIGINT AS misses, 2::BIGINT AS cap")
def result_cache(spark, sf_dir):
    """The second time a query is asked its rows are kept, the third time they are found."""
    engine = E.Engine(Dataset(_table(spark, sf_dir, "nation")), E.Options(query_cache_cap=2))
    for text in ("n_regionkey = 1", "n_regionkey  =  1", "n_regionkey = 1", "n_regionkey = 2"):
        engine.execute(text)
    found = engine.cache_stats()
    engine.close()
    return spark.createDataFrame([tuple(found[k] for k in ("hits", "misses", "cap"))], "hits long, misses long, cap long")


@registered("SELECT 4::BIGINT AS query_count, 3 * count(*) AS rows_scanned, 0.25::DOUBLE AS cache_hit_rate, true AS timed FROM nation")
def metrics(spark, sf_dir):
    """Of four executions three scan the table and one finds its rows in the cache."""
    engine = E.Engine(Dataset(_table(spark, sf_dir, "nation")))
    for text in ("n_regionkey = 1", "n_regionkey = 1", "n_regionkey = 1", 'n_name = "CHINA"'):
        engine.execute(text)
    m = engine.get_metrics()
    engine.close()
    return spark.createDataFrame([(m["query_count"], m["rows_scanned"], m["cache_hit_rate"], 0 < m["avg_latency_ms"] and 0 < m["p95_latency_ms"])], "query_count long, rows_scanned long, cache_hit_rate double, timed boolean")


@registered("SELECT count(*) AS row_count, true AS sized FROM region")
def data_size_bytes(spark, sf_dir):
    found = E.Engine(io.from_json_array(spark, _json(spark, sf_dir, "region"))).data_size()
    return spark.createDataFrame([(found["row_count"], found["approx_bytes"] >= 20 * found["row_count"])], "row_count long, sized boolean")


@registered(f"SELECT c_custkey, c_mktsegment FROM customer WHERE {_folded('c_mktsegment')} = 'building' AND c_nationkey IN (1, 2, 3)")
def index_strict_query(spark, sf_dir):
    """Strict queries without regard to case take their candidates from an index."""
    df = _table(spark, sf_dir, "customer")
    engine = E.Engine(Dataset(df.withColumn(ROW_ID, F.col("c_custkey"))), E.Options(("c_mktsegment", "c_nationkey")))
    return engine.query('c_mktsegment = "building" AND c_nationkey IN (1, 2, 3) STRICT').select("c_custkey", "c_mktsegment")


@registered("SELECT 'c_mktsegment' AS field, count(DISTINCT c_mktsegment) AS keys, count(*) AS entries FROM customer")
def index_create_and_drop(spark, sf_dir):
    engine = E.Engine(Dataset(_table(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey"))), E.Options(("c_nationkey",)))
    engine.create_index("c_mktsegment")
    engine.create_index("c_mktsegment")
    engine.drop_index("c_nationkey")
    engine.drop_index("never there")
    return engine.list_indexes()


_TERM = "ln((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"


@registered(f"""
WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array({_folded("p_name || ' ' || p_brand || ' ' || p_type")}, '[^a-z0-9]+'), lambda w: w <> '') AS w, {_folded('p_name')} AS name FROM part),
f AS (SELECT p_partkey, name, len(w) AS len, len(list_filter(w, lambda x: x = 'red'))::DOUBLE AS tf, list_contains(w, 'red') AS has FROM t),
s AS (SELECT count(*) AS n, greatest(1, avg(len)) AS avg_len, count(*) FILTER (has) AS d FROM f)
SELECT p_partkey, round({_TERM}, 6) AS "SCORE" FROM f, s WHERE contains(name, 'red')""")
def engine_text_index(spark, sf_dir):
    """The tokens that the first ranking query makes serve the second."""
    engine = E.Engine(Dataset(_table(spark, sf_dir, "part")))
    engine.query('SELECT p_partkey, SCORE WHERE p_name CONTAINS "blue"')
    return engine.query('SELECT p_partkey, SCORE WHERE p_name CONTAINS "red"').withColumn("SCORE", F.round("SCORE", 6))


# language


def _over_variant(name: str, query: str, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _fields(search(_variant(_table(spark, sf_dir, "part")), query), p_partkey="bigint", p_name="string")

    QUERIES[name], ORACLE_SQL[name] = run, f"SELECT p_partkey, p_name FROM part WHERE {condition}"


_TEXTS = ("p_name", "p_brand", "p_type")
_any = lambda test: " OR ".join(test(_folded(c)) for c in _TEXTS)
_close = lambda c: f"contains({c}, 'gizzmo') OR len(list_filter(regexp_split_to_array({c}, '[^a-z0-9]+'), lambda w: len(w) >= 3 AND damerau_levenshtein(w, 'gizzmo') <= 2)) > 0"
_over_variant("variant_free_term", "Bolt", _any(lambda c: f"contains({c}, 'bolt')"))
_over_variant("variant_free_term_key", "partkey", "true")
_over_variant("variant_prefix_term", "red*", _any(lambda c: f"starts_with({c}, 'red')"))
_over_variant("variant_suffix_term", "*bolt", _any(lambda c: f"ends_with({c}, 'bolt')"))
_over_variant("variant_infix_term", "*old*", _any(lambda c: f"contains({c}, 'old')"))
_over_variant("variant_fuzzy_term", "FUZZY gizzmo", _any(_close))
_over_variant("variant_compare", "p_size >= 10 AND NOT p_retailprice > 1000", "p_size >= 10 AND NOT p_retailprice > 1000")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("dear"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"))


@registered("SELECT o_orderkey, o_totalprice > 100000 AS dear FROM orders WHERE o_totalprice > 100000")
def bool_literal(spark, sf_dir):
    return search(Dataset(_flagged(spark, sf_dir)), "dear = true").select("o_orderkey", "dear")


@registered("SELECT o_orderkey, o_totalprice > 100000 AS dear FROM orders WHERE NOT o_totalprice > 100000")
def bool_literal_variant(spark, sf_dir):
    return _fields(search(_variant(_flagged(spark, sf_dir)), "dear IN (false)"), o_orderkey="bigint", dear="boolean")


@registered("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def null_literal(spark, sf_dir):
    return search(Dataset(_flagged(spark, sf_dir), null_policy="json_null"), "status = null").select("o_orderkey")


@registered("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def null_literal_variant(spark, sf_dir):
    return _fields(search(_variant(_flagged(spark, sf_dir)), "status = null"), o_orderkey="bigint")


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def select_star(spark, sf_dir):
    return search(Dataset(_table(spark, sf_dir, "nation")), "SELECT * WHERE n_regionkey = 3")


@registered("SELECT '{}' AS raw FROM nation WHERE n_regionkey = 3")
def select_star_compat(spark, sf_dir):
    return search(_variant(_table(spark, sf_dir, "nation"), compat_star=True), "SELECT * WHERE n_regionkey = 3").select(io.RAW)


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 4")
def clause_order(spark, sf_dir):
    return search(Dataset(_table(spark, sf_dir, "orders")), 'SELECT o_orderkey, o_totalprice WHERE o_orderstatus = "F" OFFSET 4 STRICT LIMIT 15 CASE SENSITIVE ORDER BY o_totalprice DESC, o_orderkey')


@registered("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7")
def result_cap(spark, sf_dir):
    return search(Dataset(_table(spark, sf_dir, "nation"), max_rows=7), "SELECT n_nationkey ORDER BY n_nationkey LIMIT 20")


def _placed(name: str, clause: str, sql: str, null_policy: str = "json_null") -> None:
    """Order of a column with nulls, or (``missing``) with absent fields, which NULLS FIRST doesn't move."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("held"))
        return search(Dataset(df, null_policy=null_policy), f"ORDER BY held {clause}, c_custkey LIMIT 300 OFFSET 5")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS held FROM customer ORDER BY held {sql}, c_custkey LIMIT 300 OFFSET 5"


_placed("order_nulls_asc", "", "ASC NULLS LAST")
_placed("order_nulls_asc_first", "NULLS FIRST", "ASC NULLS FIRST")
_placed("order_nulls_desc", "DESC", "DESC NULLS FIRST")
_placed("order_nulls_desc_first", "DESC NULLS FIRST", "DESC NULLS LAST")
_placed("order_missing_asc_first", "NULLS FIRST", "ASC NULLS LAST", "missing")
_placed("order_missing_desc_first", "DESC NULLS FIRST", "DESC NULLS FIRST", "missing")


@registered("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^[[:alpha:]]+#[[:digit:]]+$')")
def regex_posix(spark, sf_dir):
    return search(Dataset(_table(spark, sf_dir, "part")), 'SELECT p_partkey WHERE p_brand REGEX "^[[:alpha:]]+#[[:digit:]]+$"')


@registered("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?m)^[a-z ]+\\.$', 'i')")
def regex_multiline(spark, sf_dir):
    return search(Dataset(_table(spark, sf_dir, "documents")), 'SELECT doc_id WHERE text REGEX "(?m)^[a-z ]+\\\\.$"')


@registered(" UNION ALL ".join(f"SELECT '{name}' AS class, count(*) AS n FROM documents WHERE regexp_matches(text, '[[:{name}:]][[:^{name}:]]')" for name in sorted(POSIX)))
def regex_posix_classes(spark, sf_dir):
    docs = Dataset(_table(spark, sf_dir, "documents"))
    parts = [search(docs, f'text REGEX "[[:{name}:]][[:^{name}:]]" CASE SENSITIVE').agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("class"), "n") for name in sorted(POSIX)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Queries, whether they are valid, and where an error is.
_CHECKED = [("a = 1", True, -1), ("price > -5", False, 8), ("hello world", False, 6), ("123", False, 0), ("a NOT b", False, 6), ("price = 1.2.3", False, 8), ("a  =  1  AND  b", True, -1)]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@registered("SELECT * FROM (VALUES " + ", ".join(f"({_literal(q)}, {str(ok).lower()}, {pos}::BIGINT)" for q, ok, pos in _CHECKED) + ") t(query, ok, pos)")
def validate(spark, sf_dir):
    found = [(q, r["ok"], r["error"]["pos"] if not r["ok"] else -1) for q, _, _ in _CHECKED for r in [validate_query(q)]]
    return spark.createDataFrame(found, "query string, ok boolean, pos long")


_SPACED = [("  a   =  1 ", "a = 1"), ('a = "x   y"  AND\tb', 'a = "x   y" AND b'), ("a\n\n=\n'p  q'", "a = 'p  q'")]


@registered("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {_literal(n)})" for k, (_, n) in enumerate(_SPACED)) + ") t(k, normalized)")
def normaliser(spark, sf_dir):
    return spark.createDataFrame([(k, normalize(t)) for k, (t, _) in enumerate(_SPACED)], "k long, normalized string")


@registered("SELECT 2::BIGINT AS held, true AS same")
def query_cache(spark, sf_dir):
    """Parsed queries are kept by their normalised text, two of them here."""
    cache = QueryCache(512)
    cache.resize(2)
    one = cache.parse("a = 1")
    same = cache.parse("a   =   1") is one
    for text in ("b = 1", "c = 1"):
        cache.parse(text)
    return spark.createDataFrame([(len(cache), same)], "held long, same boolean")


@registered(f"SELECT '{__version__}' AS version")
def version(spark, sf_dir):
    return spark.createDataFrame([(__version__,)], "version string")


#: Specifications that are refused.
_REFUSED = [{"aggs": [{"op": "MEDIAN", "field": "n_regionkey"}]}, {"aggs": [{"op": "SUM"}]}, {"aggs": [{"op": "AVG"}], "group_by": ["n_name"]}]


@registered("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, true)" for k in range(len(_REFUSED))) + ") t(k, refused)")
def agg_errors(spark, sf_dir):
    data, out = Dataset(_table(spark, sf_dir, "nation")), []
    for k, spec in enumerate(_REFUSED):
        try:
            aggregate(data, spec)
            out.append((k, False))
        except SpecError:
            out.append((k, True))
    return spark.createDataFrame(out, "k long, refused boolean")
