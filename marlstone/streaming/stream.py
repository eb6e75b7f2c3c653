"""The stateless part of the query language on streams: filters and projections lower to the same Columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.search import Dataset, matched, projected
from ..plans.syntax import QueryError


def stream_search(data: Dataset, text: str) -> DataFrame:
    """Matching rows of a streaming DataFrame. Order, slices and ranking need all rows and are refused."""
    query = data.parse(text)
    if query.order or query.limit is not None or query.offset or query.needs_score:
        raise QueryError("ORDER BY, LIMIT, OFFSET and SCORE need a bounded dataset", 0)
    df, score = matched(data, query)
    return projected(df, data, query, score)
