"""A query applied to a DataFrame: filter, rank, order, slice, project."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bm25
from ..functions.values import Flags, Records
from ..plans.lowering import lower
from ..plans.parser import QUERIES
from ..plans.syntax import Everything, Query
from .ordering import sort_columns
from .projection import project_json, project_typed

ROW_ID = "_row_id"
_TOKENS, _SCORE = "_tokens", "_score"


@dataclass(frozen=True)
class Dataset:
    """Records with their number (``_row_id``), if they have one; ``record`` and ``raw`` name the VARIANT and its JSON text."""

    df: DataFrame
    record: str | None = None
    raw: str | None = None
    null_policy: str = "missing"
    #: Emulates ``SELECT *`` as empty objects.
    compat_star: bool = False
    max_rows: int | None = None
    signed: bool = False
    quoted_names: bool = False

    @property
    def records(self) -> Records:
        return Records(self.df.schema, self.record, (ROW_ID, _TOKENS, _SCORE))

    def parse(self, text: str | Query) -> Query:
        return text if isinstance(text, Query) else QUERIES.parse(text, signed=self.signed, quoted_names=self.quoted_names)

    def flags(self, query: Query) -> Flags:
        return Flags(query.case_sensitive, query.strict, self.null_policy)


def matched(data: Dataset, query: Query, tokens: DataFrame | None = None) -> tuple[DataFrame, Column | None]:
    """Matching rows, with a score column if the query ranks. ``tokens``: the rows with their tokens, kept from before."""
    condition = None if isinstance(query.where, Everything) else lower(query.where, data.records, data.flags(query))
    if not query.needs_score:
        return (data.df if condition is None else data.df.filter(condition)), None
    terms = bm25.query_terms(query.where)
    df = tokens if tokens is not None else bm25.with_tokens(data.df, data.records, _TOKENS)
    if terms:
        distinct = list(dict.fromkeys(terms))
        n, mean, found = bm25.statistics(df, distinct, _TOKENS)
        by_term = dict(zip(distinct, found, strict=True))
        score = bm25.score(terms, (n, mean, [by_term[t] for t in terms]), _TOKENS)
    else:
        score = F.lit(0.0)
    df = df if condition is None else df.filter(condition)
    return df.withColumn(_SCORE, score).drop(_TOKENS), F.col(_SCORE)


def ordered(df: DataFrame, data: Dataset, query: Query, score: Column | None) -> DataFrame:
    keys = [c for k in query.order for c in sort_columns(k, data.records, data.flags(query), score)]
    if not query.order:
        return df
    return df.orderBy(*keys, *([F.col(ROW_ID).asc()] if ROW_ID in df.columns else []))


def sliced(df: DataFrame, query: Query, data: Dataset) -> DataFrame:
    """OFFSET and LIMIT; rows without an order are taken by number where they have one."""
    limit = query.limit
    if data.max_rows is not None:
        limit = data.max_rows if limit is None else min(limit, data.max_rows)
    if (limit is not None or query.offset) and not query.order and ROW_ID in df.columns:
        df = df.orderBy(ROW_ID)
    df = df.offset(query.offset) if query.offset else df
    return df if limit is None else df.limit(limit)


def projected(df: DataFrame, data: Dataset, query: Query, score: Column | None) -> DataFrame:
    own = df.drop(_SCORE)
    if query.select is None or "*" in query.select and not data.compat_star and not data.record and query.select == ("*",):
        return own if query.select is None or ROW_ID not in own.columns else own.drop(ROW_ID)
    if data.record:
        if query.select == ("*",) and not data.compat_star:
            return own
        text = project_json(query.select, data.records, data.flags(query), score)
        kept = [F.col(ROW_ID)] if ROW_ID in df.columns else []
        return df.select(*kept, F.parse_json(text).alias(data.record), text.alias(data.raw or "raw"))
    return project_typed(df, query.select, data.records, data.flags(query), score)


def search(data: Dataset, text: str | Query, tokens: DataFrame | None = None) -> DataFrame:
    """Rows of a query, in its order."""
    query = data.parse(text)
    df, score = matched(data, query, tokens)
    return projected(sliced(ordered(df, data, query, score), query, data), data, query, score)


def row_ids(data: Dataset, text: str | Query) -> DataFrame:
    """Numbers of the rows of a query."""
    return search(data, replace(data.parse(text), select=None)).select(ROW_ID)


def total_and_page(data: Dataset, text: str | Query, tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All matches without LIMIT and OFFSET (to be counted), and the page."""
    query = data.parse(text)
    df, _ = matched(data, replace(query, select=None, order=()), tokens)
    return df, search(data, query, tokens)


def json_rows(data: Dataset, df: DataFrame) -> DataFrame:
    """One JSON text for each row, ``json``: the sink for records."""
    if data.record:
        return df.select(*([ROW_ID] if ROW_ID in df.columns else []), F.coalesce(F.col(data.raw), F.to_json(data.record)).alias("json") if data.raw and data.raw in df.columns else F.to_json(data.record).alias("json"))
    kept = [c for c in df.columns if c != ROW_ID]
    return df.select(*([ROW_ID] if ROW_ID in df.columns else []), F.to_json(F.struct(*(F.col(f"`{c}`") for c in kept))).alias("json"))


def typed(df: DataFrame, **options) -> Dataset:
    """A dataset over typed columns."""
    return Dataset(df, **options)


