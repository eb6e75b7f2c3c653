"""Free-text terms over whole records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fuzzy as fz
from .text import folded, holds, number_text
from .values import Flags, Records

_TEST: dict[str, Callable[[str, str], bool]] = {"contains": lambda s, t: t in s, "starts": str.startswith, "ends": str.endswith}


def _exists(column: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(column, lambda e: F.coalesce(test(e), F.lit(False)))


def _leaves(column: Column, kind: T.DataType) -> Iterator[tuple[Column, T.DataType, Callable[[Callable[[Column], Column]], Column]]]:
    """Scalars below a typed column, each with how a test of it becomes a test of the record."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(column.getField(f.name), f.dataType)
    elif isinstance(kind, T.ArrayType):
        yield column, kind.elementType, lambda test: _exists(column, test)
    elif isinstance(kind, T.MapType):
        yield F.map_values(column), kind.valueType, lambda test: _exists(F.map_values(column), test)
    else:
        yield column, kind, lambda test: test(column)


def _text_test(kind: T.DataType, text: str, how: str, flags: Flags) -> Callable[[Column], Column] | None:
    """Test of one scalar; None if its type can't match."""
    want = folded(text, flags.case_sensitive)

    def test(shown: Callable[[Column], Column]) -> Callable[[Column], Column]:
        if how == "fuzzy":
            return lambda c: fz.fuzzy(shown(c), text, flags.case_sensitive)
        return lambda c: holds(shown(c), text, flags.case_sensitive, how)

    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        return test(lambda c: c)
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return test(lambda c: c.cast("string"))
    if isinstance(kind, T.BooleanType):
        words = [w for w in ("true", "false") if (fz.matches(w, text, flags.case_sensitive) if how == "fuzzy" else _TEST[how](w, want))]
        return (lambda c: c.cast("string").isin(words)) if words else None
    if isinstance(kind, T.NumericType):
        if how != "fuzzy" and not re.fullmatch(r"[-+.0-9einfa]*", want):
            return None
        return test(lambda c: number_text(c, isinstance(kind, T.IntegralType)))
    return None


def _keys(fields: list[T.StructField]) -> Iterator[tuple[str, list[str]]]:
    for f in fields:
        yield f.name, [f.name]
        if isinstance(f.dataType, T.StructType):
            for name, path in _keys(f.dataType.fields):
                yield name, [f.name, *path]


def term(records: Records, text: str, how: str, flags: Flags, raw: str | None = "raw") -> Column:
    """Whether any value (for ``contains`` and ``fuzzy`` any key too) matches."""
    if records.record:
        return _json_term(F.col(records.record), F.col(raw) if raw else F.to_json(F.col(records.record)), text, how, flags)
    if how == "fuzzy" and not text:
        return F.lit(False)
    tests: list[Column] = []
    if how in ("contains", "fuzzy"):
        for name, path in _keys(records.fields()):
            hit = fz.matches(name, text, flags.case_sensitive) if how == "fuzzy" else folded(text, flags.case_sensitive) in folded(name, flags.case_sensitive)
            if hit and flags.null_policy == "json_null" and len(path) == 1:
                return F.lit(True)
            if hit:
                column = F.col(f"`{path[0]}`")
                for p in path[1:]:
                    column = column.getField(p)
                tests.append(column.isNotNull())
    for f in records.fields():
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.VariantType):
            tests.append(_json_term(column, F.to_json(column), text, how, flags))
            continue
        if isinstance(f.dataType, T.MapType) and how in ("contains", "fuzzy"):
            key_test = _text_test(f.dataType.keyType, text, how, flags)
            if key_test:
                tests.append(_exists(F.map_keys(column), key_test))
        for _, kind, lift in _leaves(column, f.dataType):
            test = _text_test(kind, text, how, flags)
            if test:
                tests.append(lift(test))
    out = F.lit(False)
    for t in tests:
        out = t if out is None else out | t
    return out


def json_number(x: int | Decimal | float | str) -> str:
    """A number as JSON writers print it, from its JSON spelling."""
    s = str(x)
    if re.fullmatch(r"-?[0-9]+", s) and abs(int(s)) < 1 << 64:
        return s
    f = float(s)
    if f == 0 or 1e-5 <= abs(f) < 1e16:
        out = format(Decimal(repr(f)), "f")
        return out if "." in out else out + ".0"
    return re.sub(r"e([+-])0*", lambda m: "e" + ("-" if m[1] == "-" else ""), repr(f)).replace(".0e", "e")


def _scalars(value, keys: bool) -> Iterator[str]:
    """Texts of a JSON value: strings, numbers, booleans, and keys if wanted; nulls have none."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if keys:
                yield from v
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
        elif isinstance(v, bool):
            yield "true" if v else "false"
        elif isinstance(v, _Number):
            yield json_number(v)
        elif isinstance(v, str):
            yield v


class _Number(str):
    """A number's spelling, told apart from strings."""


def _parsed(source: str):
    return json.loads(source, parse_float=_Number, parse_int=_Number, parse_constant=_Number)


def json_fuzzy(text: str, case_sensitive: bool) -> Callable[[str | None], bool]:
    """The fuzzy test of JSON records, which remembers the tokens it has seen."""
    t = folded(text, case_sensitive)
    known = fz.nearby(t)
    # numbers may be spelled otherwise in the source; this tells that none matches, however spelled
    plain = sum(c not in "0123456789+-.einfa" for c in t) > fz.bound(t)

    def test(source: str | None) -> bool:
        if source is None:
            return False
        value = _parsed(source)
        # without escapes, all texts and keys stand in the source between quotes
        if plain and "\\" not in source and not fz.holds_near(source, t, known, case_sensitive):
            return False
        return any(fz.holds_near(s, t, known, case_sensitive) for s in _scalars(value, True))

    return test


def json_matches(source: str | None, text: str, how: str, case_sensitive: bool) -> bool:
    if how == "fuzzy":
        return json_fuzzy(text, case_sensitive)(source)
    if source is None:
        return False
    value = _parsed(source)
    want, test = folded(text, case_sensitive), _TEST[how]
    return any(test(folded(s, case_sensitive), want) for s in _scalars(value, how == "contains"))


def _json_term(record: Column, source: Column, text: str, how: str, flags: Flags) -> Column:
    """On records of any depth, in batches in Python; a cheap necessary condition keeps most records out."""
    sensitive = flags.case_sensitive

    @F.pandas_udf("boolean")
    def found(sources: pd.Series) -> pd.Series:
        test = json_fuzzy(text, sensitive) if how == "fuzzy" else lambda s: json_matches(s, text, how, sensitive)
        return sources.map(test).astype(bool)

    want = folded(text, sensitive)
    # letters and blanks are spelled as they are in canonical JSON; numbers, escapes and quotes may not be
    plain = how != "fuzzy" and re.fullmatch(r"[A-Za-z_ ]{2,}", want) and not re.fullmatch(r"(?i)[infae]*", want)
    may = F.when(holds(F.to_json(record), text, sensitive), source) if plain else source
    return F.coalesce(found(may), F.lit(False))
