"""Group-by, global and distinct aggregation from a JSON specification.

``{"group_by": [paths], "aggs": [{"op", "field", "alias"}], "distinct_fields": [paths], "filter": query}``
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Flags, Missing, Value, Variant
from .search import ROW_ID, Dataset, search

_OPS = {"COUNT", "SUM", "AVG", "MIN", "MAX"}


class SpecError(ValueError):
    """A specification that can't be run."""


@dataclass(frozen=True)
class Aggregation:
    op: str
    path: str | None
    alias: str


@dataclass(frozen=True)
class Spec:
    group_by: tuple[str, ...] = ()
    aggs: tuple[Aggregation, ...] = ()
    distinct: tuple[str, ...] = ()
    filter: str | None = None
    options: dict = field(default_factory=dict)


def parse_spec(spec: str | dict) -> Spec:
    """Checks operators and fields at once, whether or not there are rows."""
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except json.JSONDecodeError as e:
            raise SpecError(f"Invalid spec: {e}") from None
    if not isinstance(spec, dict):
        raise SpecError("Invalid spec: an object is expected")
    aggs = []
    for a in spec.get("aggs") or ():
        op, path = str(a.get("op", "")).upper(), a.get("field")
        if op not in _OPS:
            raise SpecError(f"Unknown aggregate op: {a.get('op')}")
        if op != "COUNT" and not path:
            raise SpecError("Aggregate field required")
        aggs.append(Aggregation(op, None if path in (None, "*") and op == "COUNT" else path, a.get("alias") or f"{op}_{path or '*'}"))
    return Spec(tuple(spec.get("group_by") or ()), tuple(aggs), tuple(spec.get("distinct_fields") or ()), spec.get("filter"))


def _group_key(value: Value) -> Column:
    """Groups go by JSON text, so that a missing field meets null and strings keep their case; typed scalars group as they are."""
    if isinstance(value, Missing):
        return F.lit(None).cast("string")
    if isinstance(value, Variant):
        return F.when(~F.coalesce(value.null(), F.lit(True)), F.to_json(value.column))
    if isinstance(value.kind, T.StructType | T.MapType | T.ArrayType):
        return F.to_json(value.column)
    return value.column


def _shown(value: Value, key: Column) -> Column:
    """What a group key is shown as: VARIANT again for JSON records."""
    return F.parse_json(F.coalesce(key, F.lit("null"))) if isinstance(value, Variant) else key


def _measure(a: Aggregation, values: dict[str, Value]) -> Column:
    value = values[a.path] if a.path else None
    if a.op == "COUNT":
        return F.count(F.lit(1)) if value is None else F.count_if(F.coalesce(value.present(), F.lit(False)))
    number = value.number()
    number = F.lit(None).cast("double") if number is None else number
    return {"SUM": F.coalesce(F.sum(number), F.lit(0.0)), "AVG": F.avg(number), "MIN": F.min(number), "MAX": F.max(number)}[a.op]


def _shared(aggs: tuple[Aggregation, ...], values: dict[str, Value]) -> list[Column]:
    """Emulates one accumulator for all aggregations of a group: counts and sums add up over all of them."""
    counts, sums, lows, highs = [], [], [], []
    for a in aggs:
        if a.op == "COUNT":
            counts.append(_measure(a, values))
            continue
        number = values[a.path].number()
        number = F.lit(None).cast("double") if number is None else number
        counts.append(F.count(number))
        sums.append(F.coalesce(F.sum(number), F.lit(0.0)))
        lows.append(F.min(number))
        highs.append(F.max(number))
    total = lambda xs, zero: sum(xs[1:], xs[0]) if xs else F.lit(zero)
    least = lambda f, xs: xs[0] if len(xs) == 1 else f(*xs) if xs else F.lit(None).cast("double")
    count, sum_ = total(counts, 0), total(sums, 0.0)
    return [{"COUNT": count, "SUM": sum_, "AVG": F.when(count > 0, sum_ / count), "MIN": least(F.least, lows), "MAX": least(F.greatest, highs)}[a.op] for a in aggs]


def aggregate(data: Dataset, spec: str | dict | Spec, shared_state: bool = False) -> DataFrame:
    """Rows of groups (unordered), or distinct rows in the order they come first.

    Without rows there is no result row, with or without groups. An alias that equals a group's name takes its place.
    """
    s = spec if isinstance(spec, Spec) else parse_spec(spec)
    df = data.df
    if s.filter:
        query = data.parse(s.filter)
        df = search(data, query.__class__(**(query.__dict__ | {"select": None})))
    inner = Dataset(df, **{k: getattr(data, k) for k in ("record", "raw", "null_policy")})
    flags = Flags(null_policy=data.null_policy)
    value = lambda path: inner.records.value(path, flags)
    if s.distinct and not s.aggs and not s.group_by:
        return _distinct(df, {p: value(p) for p in s.distinct})
    groups = {p: value(p) for p in s.group_by}
    values = {a.path: value(a.path) for a in s.aggs if a.path}
    keys = [_group_key(v).alias(f"_key{k}") for k, v in enumerate(groups.values())]
    measures = _shared(s.aggs, values) if shared_state and s.aggs else [_measure(a, values) for a in s.aggs]
    out = {p: _shown(v, F.col(f"_key{k}")) for k, (p, v) in enumerate(groups.items())}
    if not keys and not measures:
        return df.limit(1).select(F.lit(True).alias("_any")).drop("_any")
    if not keys:
        counted = df.agg(F.count(F.lit(1)).alias("_rows"), *(m.alias(f"_m{k}") for k, m in enumerate(measures))).where("_rows > 0")
    elif measures:
        counted = df.groupBy(*keys).agg(*(m.alias(f"_m{k}") for k, m in enumerate(measures)))
    else:
        counted = df.select(*keys).distinct()
    for k, a in enumerate(s.aggs):
        out[a.alias] = F.col(f"_m{k}")
    return counted.select(*(c.alias(name) for name, c in out.items()))


def _distinct(df: DataFrame, values: dict[str, Value]) -> DataFrame:
    names = [f"_key{k}" for k in range(len(values))]
    keyed = df.select(*(_group_key(v).alias(n) for n, v in zip(names, values.values(), strict=True)), *([ROW_ID] if ROW_ID in df.columns else []))
    shown = [_shown(v, F.col(n)).alias(p) for n, (p, v) in zip(names, values.items(), strict=True)]
    if ROW_ID in df.columns:
        return keyed.groupBy(*names).agg(F.min(ROW_ID).alias(ROW_ID)).orderBy(ROW_ID).select(*shown)
    return keyed.distinct().select(*shown)


__all__ = ["Aggregation", "Spec", "SpecError", "aggregate", "parse_spec"]
