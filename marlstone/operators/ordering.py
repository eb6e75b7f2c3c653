"""ORDER BY keys.

Values come before missing fields, JSON nulls after both (or first with NULLS FIRST), and DESC turns the whole order round, null placement
included. Values of different types stand by type, as their JSON text would: string, number, array, boolean, object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold
from ..functions.values import Missing, Records, Typed, Value, Variant, Flags
from ..plans.syntax import SortKey


def sort_columns(key: SortKey, records: Records, flags: Flags, score: Column | None) -> list[Column]:
    if key.is_score:
        return [_way((F.lit(0.0) if score is None else score), key)]
    value = records.value(key.path, flags)
    if isinstance(value, Missing):
        return []
    null_rank = 0 if key.nulls_first else 3
    if isinstance(value, Variant):
        rank = F.when(~value.present(), 2).when(value.null(), null_rank).otherwise(1)
        kind = value.kind
        by_type = F.when(kind == "STRING", 0).when(kind.startswith("ARRAY"), 2).when(kind == "BOOLEAN", 3).when(kind.startswith("OBJECT"), 4).otherwise(1)
        text = F.when(kind == "STRING", fold(value.text(), flags.case_sensitive)).when(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "BOOLEAN"), F.to_json(value.column))
        return [_way(c, key) for c in (rank, by_type, value.number(), text)]
    assert isinstance(value, Typed)
    if flags.null_policy == "json_null":
        rank = F.when(value.column.isNull(), null_rank).otherwise(1)
        return [_way(rank, key), _way(_scalar(value, flags), key)]
    # missing is after the values: last if ascending, first if descending
    own = _scalar(value, flags)
    return [own.desc_nulls_first() if key.descending else own.asc_nulls_last()]


def _scalar(value: Value, flags: Flags) -> Column:
    if isinstance(value.kind, T.StringType):
        return fold(value.column, flags.case_sensitive)
    if isinstance(value.kind, T.ArrayType | T.StructType | T.MapType):
        return F.to_json(value.column)
    return value.column


def _way(column: Column, key: SortKey) -> Column:
    return column.desc_nulls_last() if key.descending else column.asc_nulls_first()
