"""BM25 over the strings of a record; statistics are those of the whole dataset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import Node, Predicate, Term, walk
from .spread import spread
from .text import tokenize, tokens
from .values import Records

K1, B = 1.2, 0.75
_TEXT_OPS = {"LIKE", "NOT LIKE", "CONTAINS", "STARTS", "ENDS", "=", "!="}


def query_terms(where: Node) -> list[str]:
    """Tokens of plain terms and of the string literals of text predicates, each time they occur; what stands under NOT counts too."""
    out: list[str] = []
    for node in walk(where):
        if isinstance(node, Term) and node.plain:
            out += tokenize(node.text)
        elif isinstance(node, Predicate) and node.op in _TEXT_OPS:
            out += [t for v in node.values if isinstance(v, str) for t in tokenize(v)]
    return out


def document_text(records: Records) -> Column:
    """All string values of a record, blank between; no keys, numbers or booleans."""
    if records.record:
        return _variant_text(F.col(records.record))
    parts = [p for f in records.fields() for p in _strings(F.col(f"`{f.name}`"), f.dataType)]
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def _strings(column: Column, kind: T.DataType) -> list[Column]:
    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        return [column]
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _strings(column.getField(f.name), f.dataType)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return [F.array_join(column, " ")]
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return [F.array_join(F.map_values(column), " ")]
    return [_variant_text(column)] if isinstance(kind, T.VariantType) else []


def _variant_text(column: Column) -> Column:
    @F.pandas_udf("string")
    def strings(sources):
        import json

        from .freetext import _Number

        def text(s):
            value = json.loads(s, parse_float=_Number, parse_int=_Number)
            return " ".join(x for x in _only_strings(value))

        def _only_strings(v):
            if isinstance(v, dict):
                for x in v.values():
                    yield from _only_strings(x)
            elif isinstance(v, list):
                for x in v:
                    yield from _only_strings(x)
            elif isinstance(v, str) and not isinstance(v, _Number):
                yield v

        return sources.map(lambda s: "" if s is None else text(s))

    return F.coalesce(strings(F.to_json(column)), F.lit(""))


def with_tokens(df: DataFrame, records: Records, name: str) -> DataFrame:
    df = spread(df)
    return df.withColumn(name, tokens(document_text(records)))


def statistics(df: DataFrame, terms: list[str], name: str) -> tuple[int, float, list[int]]:
    """Documents, mean length and documents with each term, in one pass with one row."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(name)).alias("length"), *(F.count_if(F.array_contains(name, t)).alias(f"d{k}") for k, t in enumerate(terms))).first()
    return row["n"], max(1.0, row["length"] or 1.0), [row[f"d{k}"] for k in range(len(terms))]


def score(terms: list[str], stats: tuple[int, float, list[int]], name: str) -> Column:
    """Sum over the query's terms; 0 without terms."""
    n, mean, found = stats
    out = F.lit(0.0)
    for t, d in zip(terms, found, strict=True):
        if d:
            tf = (F.size(name) - F.size(F.array_remove(name, t))).cast("double")
            out = out + F.lit(math.log((n - d + 0.5) / (d + 0.5) + 1)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(name) / mean))
    return out
