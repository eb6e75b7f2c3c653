"""The registered queries of the record engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine_queries
from .operators.aggregate import aggregate
from .operators.engine import Engine, Options, average_by, count_by, page_query
from .operators.search import ROW_ID, Dataset, search
from .sources.records import gunzip_column, gzip_column, read_parquet

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def data(spark: SparkSession, sf_dir: str, name: str, **options) -> Dataset:
    json_columns = ("props",) if name == "events" else ()
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", json_columns, signed=True, **options)


def _query(name: str, table: str, text: str, sql: str, columns: str | None = None) -> None:
    """A query over a table; events are shown without their VARIANT column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = search(data(spark, sf_dir, table), text)
        return df.select(*columns.split()) if columns else df

    QUERIES[name], ORACLE_SQL[name] = run, sql


def _aggregate(name: str, table: str, spec: dict, sql: str, round_to: dict[str, int] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = aggregate(data(spark, sf_dir, table), spec)
        return df.withColumns({c: F.round(c, n) for c, n in (round_to or {}).items()})

    QUERIES[name], ORACLE_SQL[name] = run, sql


def _where(name: str, table: str, text: str, condition: str, columns: str | None = None) -> None:
    _query(name, table, text, f"SELECT {', '.join(columns.split()) if columns else '*'} FROM {table} WHERE {condition}", columns)


def fold(column: str) -> str:
    return _FOLD.format(column)


EVENT = "event_id user_id event_type"
_K = "TRY_CAST(json_extract(props, '$.k') AS DOUBLE)"

# value matching
_where("eq_string", "orders", 'o_orderstatus = "f"', f"{fold('o_orderstatus')} = 'f'")
_where("eq_case_sensitive", "orders", 'o_orderstatus = "F" CASE SENSITIVE', "o_orderstatus = 'F'")
_where("eq_long_string", "customer", 'c_mktsegment = "building"', f"{fold('c_mktsegment')} = 'building'")
_where("eq_number_from_string", "lineitem", 'l_linenumber = "3"', "l_linenumber = 3")
_where("eq_number_strict", "lineitem", 'l_linenumber = "3" STRICT', "false")
_where("eq_fraction_on_integer", "lineitem", "l_linenumber = 2.5", "false")
_where("neq", "customer", 'c_mktsegment != "BUILDING"', f"{fold('c_mktsegment')} <> 'building'")
_where("gt", "lineitem", "l_quantity > 45", "l_quantity > 45")
_where("gte", "lineitem", "l_quantity >= 45", "l_quantity >= 45")
_where("lt", "lineitem", "l_linenumber < 2.5", "l_linenumber < 2.5")
_where("lte", "lineitem", "l_quantity <= 3", "l_quantity <= 3")
_where("gt_negative", "customer", "c_acctbal < -500", "c_acctbal < -500")
_where("field_to_field", "lineitem", "l_linenumber = l_quantity", "l_linenumber = l_quantity")
_where("field_greater_field", "part", "p_retailprice > p_size", "p_retailprice > p_size")
_where("between_paren", "lineitem", "l_discount BETWEEN (0.05, 0.07)", "l_discount BETWEEN 0.05 AND 0.07")
_where("between_and", "orders", "o_totalprice BETWEEN 1000 AND 50000", "o_totalprice BETWEEN 1000 AND 50000")
_where("in_list", "customer", 'c_mktsegment IN ("BUILDING", machinery)', f"{fold('c_mktsegment')} IN ('building', 'machinery')")
_where("not_in", "customer", 'c_mktsegment NOT IN ("BUILDING", "MACHINERY")', f"{fold('c_mktsegment')} NOT IN ('building', 'machinery')")
_where("in_empty", "customer", "c_mktsegment IN ()", "false")
_where("in_numbers", "part", 'p_size IN (1, "7", 15)', "p_size IN (1, 7, 15)")

# patterns
_where("like", "part", 'p_name LIKE "%ring%"', f"{fold('p_name')} LIKE '%ring%'")
_where("like_one_character", "part", 'p_type LIKE "S_ALL"', f"{fold('p_type')} LIKE 's_all'")
_where("not_like", "part", 'p_name NOT LIKE "%ring%"', f"{fold('p_name')} NOT LIKE '%ring%'")
_where("regex", "part", 'p_name REGEX "^(red|hot) .*r$"', "regexp_matches(p_name, '^(red|hot) .*r$', 'i')")
_where("not_regex", "part", 'p_name NOT REGEX "^(red|hot) .*r$"', "NOT regexp_matches(p_name, '^(red|hot) .*r$', 'i')")
_where("regex_case_sensitive", "documents", 'text REGEX "\\\\bThe [a-z]+" CASE SENSITIVE', "regexp_matches(text, '\\bThe [a-z]+')", "doc_id")
_where("contains", "documents", 'text CONTAINS "the"', f"contains({fold('text')}, 'the')", "doc_id")
_where("contains_case_sensitive", "documents", 'text CONTAINS "The" CASE SENSITIVE', "contains(text, 'The')", "doc_id")
_where("starts_with", "part", 'p_name STARTS WITH "red"', f"starts_with({fold('p_name')}, 'red')")
_where("ends_with", "part", 'p_name ENDS WITH "bolt"', f"ends_with({fold('p_name')}, 'bolt')")

# arrays, VARIANT, presence
_where("array_element", "embeddings", "embedding.0 > 0.2", "embedding[1] > 0.2", "vec_id label")
_where("array_any", "embeddings", "embedding > 0.35", "list_max(embedding) > 0.35", "vec_id label")
_where("array_between", "embeddings", "embedding BETWEEN (0.3, 0.4)", "len(list_filter(embedding, lambda x: x BETWEEN 0.3 AND 0.4)) > 0", "vec_id label")
_where("json_path", "events", "props.k > 50", f"{_K} > 50", EVENT)
_where("json_between", "events", "props.k BETWEEN 10 AND 20", f"{_K} BETWEEN 10 AND 20", EVENT)
_where("json_in", "events", 'props.k IN (1, "2", 3)', f"{_K} IN (1, 2, 3)", EVENT)
_where("json_not_equal", "events", "props.k != 7", f"{_K} <> 7", EVENT)
_where("exists", "events", "props.k EXISTS", "json_exists(props, '$.k')", EVENT)
_where("is_null", "events", "props.zzz IS NULL", "true", EVENT)
_where("is_not_null", "events", "props.k IS NOT NULL", f"{_K} IS NOT NULL", EVENT)
_where("missing_not_equal", "events", "props.zzz != 1", "false", EVENT)
_where("not_missing_equal", "events", "NOT props.zzz = 1", "true", EVENT)

# fuzzy and free text
_NEAR = "len(list_filter(regexp_split_to_array({c}, '[^a-z0-9]+'), lambda w: len(w) >= 3 AND damerau_levenshtein(w, '{t}') <= {n})) > 0"


def near(column: str, term: str, most: int) -> str:
    c = fold(column)
    return f"(contains({c}, '{term}') OR " + _NEAR.format(c=c, t=term, n=most) + ")"


_where("fuzzy", "part", 'p_name FUZZY "anvl"', near("p_name", "anvl", 1))
_where("not_fuzzy", "part", 'p_name NOT FUZZY "anvl"', f"NOT {near('p_name', 'anvl', 1)}")
_where("fuzzy_longer", "part", 'p_name FUZZY "gizzmo"', near("p_name", "gizzmo", 2))
_where("free_term", "region", "africa", f"contains({fold('r_name')}, 'africa')")
_where("free_term_number", "nation", '"7"', "contains(n_nationkey::VARCHAR, '7') OR contains(n_regionkey::VARCHAR, '7') OR contains(n_name, '7')")
_where("free_term_key", "region", "regionkey", "true")
_where("prefix_term", "part", "red*", f"starts_with({fold('p_name')}, 'red') OR starts_with({fold('p_brand')}, 'red') OR starts_with({fold('p_type')}, 'red')")
_where("suffix_term", "part", "*bolt", f"ends_with({fold('p_name')}, 'bolt') OR ends_with({fold('p_brand')}, 'bolt') OR ends_with({fold('p_type')}, 'bolt')")
_where("infix_term", "part", "*old*", f"contains({fold('p_name')}, 'old') OR contains({fold('p_brand')}, 'old') OR contains({fold('p_type')}, 'old')")
_where("fuzzy_term", "part", "FUZZY gizzmo", " OR ".join(near(c, "gizzmo", 2) for c in ("p_name", "p_brand", "p_type")))
_where("bool_nesting", "orders", '(o_orderstatus = "F" OR o_orderpriority LIKE "1%") AND NOT o_totalprice > 100000', f"({fold('o_orderstatus')} = 'f' OR o_orderpriority LIKE '1%') AND NOT o_totalprice > 100000")
_where("match_all", "nation", "", "true")
_where("trailing_or", "nation", 'n_name = "CHINA" OR', "true")

# order, slices, projection, ranking
_query("order_limit", "orders", 'o_orderstatus = "F" AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20', f"SELECT * FROM orders WHERE {fold('o_orderstatus')} = 'f' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_query("order_limit_offset", "customer", "ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 15", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 15")
_query("order_multi", "part", "p_size < 10 ORDER BY p_type, p_size DESC, p_partkey LIMIT 50", f"SELECT * FROM part WHERE p_size < 10 ORDER BY {fold('p_type')}, p_size DESC, p_partkey LIMIT 50")
_query("order_json", "events", "ORDER BY props.k DESC, event_id LIMIT 25", f"SELECT event_id, user_id, event_type FROM events ORDER BY {_K} DESC NULLS FIRST, event_id LIMIT 25", EVENT)
_query("projection", "customer", "SELECT c_name, c_acctbal WHERE c_acctbal > 9000", "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 9000")
_query("projection_unknown_field", "nation", "SELECT n_name, n_missing", "SELECT n_name FROM nation")


def _projection_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = search(data(spark, sf_dir, "events"), "SELECT event_id, props.k WHERE props.k > 50")
    return df.select("event_id", F.variant_get("props.k", "$", "bigint").alias("k"))


QUERIES["projection_nested"] = _projection_nested
ORACLE_SQL["projection_nested"] = f"SELECT event_id, {_K}::BIGINT AS k FROM events WHERE {_K} > 50"


def _ranked(text: str, rows: str = "") -> tuple[Run, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(data(spark, sf_dir, "documents"), text).withColumn("SCORE", F.round("SCORE", 6))

    term = "ln((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"
    sql = f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({fold("text || ' ' || lang || ' ' || source")}, '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS tf, list_contains(w, 'the') AS has FROM t),
s AS (SELECT count(*) AS n, greatest(1, avg(len)) AS avg_len, count(*) FILTER (has) AS d FROM f)
SELECT f.doc_id, round({term}, 6) AS "SCORE" FROM f, s, documents WHERE f.doc_id = documents.doc_id AND contains({fold("text")}, 'the') {rows}"""
    return run, sql


QUERIES["bm25_score"], ORACLE_SQL["bm25_score"] = _ranked('SELECT doc_id, SCORE WHERE text CONTAINS "the"')
QUERIES["bm25_topk"], ORACLE_SQL["bm25_topk"] = _ranked('SELECT doc_id, SCORE WHERE text CONTAINS "the" ORDER BY SCORE DESC, doc_id LIMIT 20', "ORDER BY 2 DESC, 1 LIMIT 20")

# aggregation
_N = {"op": "COUNT", "field": "*", "alias": "n"}
_aggregate("agg_count_group", "lineitem", {"group_by": ["l_returnflag", "l_linestatus"], "aggs": [_N]}, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
_aggregate("agg_count_field", "events", {"aggs": [{"op": "COUNT", "field": "props.k", "alias": "n"}]}, "SELECT count(*) FILTER (json_exists(props, '$.k')) AS n FROM events")
_aggregate("agg_sum", "lineitem", {"group_by": ["l_returnflag"], "aggs": [{"op": "SUM", "field": "l_quantity"}]}, 'SELECT l_returnflag, round(sum(l_quantity), 4) AS "SUM_l_quantity" FROM lineitem GROUP BY 1', {"SUM_l_quantity": 4})
_aggregate("agg_avg", "lineitem", {"group_by": ["l_returnflag"], "aggs": [{"op": "AVG", "field": "l_extendedprice", "alias": "avg_price"}]}, "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY 1", {"avg_price": 4})
_aggregate("agg_min_max", "orders", {"group_by": ["o_orderpriority"], "aggs": [{"op": "MIN", "field": "o_totalprice", "alias": "low"}, {"op": "MAX", "field": "o_totalprice", "alias": "high"}]}, "SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
_aggregate("agg_filter", "orders", {"group_by": ["o_orderstatus"], "aggs": [_N], "filter": "o_totalprice > 100000"}, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
_aggregate("agg_filter_limit", "orders", {"aggs": [_N], "filter": "o_totalprice > 100000 LIMIT 7"}, "SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 100000 LIMIT 7)")
_aggregate("agg_global", "lineitem", {"aggs": [_N, {"op": "AVG", "field": "l_quantity", "alias": "mean"}]}, "SELECT count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem", {"mean": 4})
_aggregate("agg_json_group", "events", {"group_by": ["event_type"], "aggs": [{"op": "AVG", "field": "props.k", "alias": "k"}, {"op": "MAX", "field": "props.k", "alias": "most"}]}, f"SELECT event_type, round(avg({_K}), 4) AS k, max({_K}) AS most FROM events GROUP BY 1", {"k": 4})
_aggregate("agg_empty", "orders", {"aggs": [_N], "filter": "o_totalprice > 100000000000"}, "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000000000 HAVING count(*) > 0")
_aggregate("agg_sum_of_text", "orders", {"group_by": ["o_orderstatus"], "aggs": [{"op": "SUM", "field": "o_orderpriority", "alias": "none"}]}, "SELECT o_orderstatus, 0.0::DOUBLE AS none FROM orders GROUP BY 1")
_aggregate("agg_group_only", "customer", {"group_by": ["c_nationkey"]}, "SELECT DISTINCT c_nationkey FROM customer")
_aggregate("distinct", "orders", {"distinct_fields": ["o_orderstatus", "o_orderpriority"]}, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_aggregate("ui_count_by", "customer", count_by("c_mktsegment", "c_acctbal > 0"), 'SELECT c_mktsegment, count(*) AS "count" FROM customer WHERE c_acctbal > 0 GROUP BY 1')
_aggregate("ui_average_by", "part", average_by("p_retailprice", "p_type"), "SELECT p_type, round(avg(p_retailprice), 4) AS avg FROM part GROUP BY 1", {"avg": 4})


# engine


def _paged_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, page = Engine(data(spark, sf_dir, "orders")).page(page_query('o_orderstatus = "F" ORDER BY o_totalprice DESC, o_orderkey', 3, 10))
    return page.select(F.lit(total).cast("long").alias("total_matches"), "o_orderkey", "o_totalprice")


def _numbered(spark: SparkSession, sf_dir: str, name: str, key: str) -> Dataset:
    d = data(spark, sf_dir, name)
    return Dataset(d.df.withColumn(ROW_ID, F.col(key).cast("long")), signed=True)


def _row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_numbered(spark, sf_dir, "region", "r_regionkey")).row_ids("*a*")


def _index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_numbered(spark, sf_dir, "customer", "c_custkey"), Options(("c_mktsegment", "c_nationkey"))).list_indexes()


def _data_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(Engine(data(spark, sf_dir, "region")).data_size()["row_count"],)], "row_count long")


def _gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data(spark, sf_dir, "documents").df
    return docs.select("doc_id", gunzip_column(gzip_column(F.col("text"))).alias("text"))


QUERIES |= {"paged_total": _paged_total, "row_ids": _row_ids, "index_stats": _index_stats, "data_size": _data_size, "gzip_roundtrip": _gzip_roundtrip}
ORACLE_SQL |= {
    "paged_total": f"SELECT (SELECT count(*) FROM orders WHERE {fold('o_orderstatus')} = 'f') AS total_matches, o_orderkey, o_totalprice FROM orders WHERE {fold('o_orderstatus')} = 'f' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20",
    "row_ids": f"SELECT r_regionkey::BIGINT AS {ROW_ID} FROM region WHERE true",
    "index_stats": "SELECT 'c_mktsegment' AS field, count(DISTINCT c_mktsegment) AS keys, count(*) AS entries FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), count(*) FROM customer",
    "data_size": "SELECT count(*) AS row_count FROM region",
    "gzip_roundtrip": "SELECT doc_id, text FROM documents",
}

QUERIES |= engine_queries.QUERIES
ORACLE_SQL |= engine_queries.ORACLE_SQL
