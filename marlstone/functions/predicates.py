"""Predicates as Columns: a table from operator to its test, and its complement for what stands under NOT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.syntax import Literal, Predicate, Ref
from .fuzzy import fuzzy
from .text import holds, java_pattern, like
from .values import Flags, Records, Typed, Value, _any

_FLIPPED = {">": "<=", ">=": "<", "<": ">=", "<=": ">"}


def predicate(records: Records, p: Predicate, flags: Flags, negated: bool = False) -> Column:
    """True where the predicate holds (or, ``negated``, where it doesn't); false or null elsewhere."""
    value = records.value(p.path, flags)
    if negated:
        plain = _plain_complement(value, p, flags)
        return ~F.coalesce(_positive(records, value, p, flags), F.lit(False)) if plain is None else plain
    return _positive(records, value, p, flags)


def _plain_complement(value: Value, p: Predicate, flags: Flags) -> Column | None:
    """Complements that a scan can take: of presence, and of comparisons of a typed number."""
    if p.op == "EXISTS":
        return ~value.present()
    if p.op == "IS NULL":
        return value.present() & ~F.coalesce(value.null(), F.lit(False))
    if isinstance(value, Typed) and value.number() is not None and len(p.values) == 1 and isinstance(p.values[0], float):
        if p.op in _FLIPPED:
            return value.column.isNull() | value.compare(_FLIPPED[p.op], p.values[0])
        if p.op == "!=":
            return value.column.isNull() | value.compare("=", p.values[0])
    return None


def _positive(records: Records, value: Value, p: Predicate, flags: Flags) -> Column:
    op = p.op
    if op == "EXISTS":
        return value.present()
    if op == "IS NULL":
        return ~value.present() | F.coalesce(value.null(), F.lit(False))
    if op == "IS NOT NULL":
        return value.present() & ~F.coalesce(value.null(), F.lit(False))
    if op in ("=", "!="):
        return value.any_element(_equality(records, p.values[0], flags, op == "!="))
    if op in _FLIPPED:
        return value.any_element(lambda v: _ordered(records, v, op, p.values[0], flags))
    if op == "BETWEEN":
        return _between(records, value, p.values, flags)
    if op in ("IN", "NOT IN"):
        listed = value.any_element(lambda v: _any([v.equal(x) for x in p.values]))
        return listed if op == "IN" else value.present() & ~F.coalesce(listed, F.lit(False))
    if op in ("FUZZY", "NOT FUZZY"):
        near = _fuzzy(value, p.values[0], flags)
        return near if op == "FUZZY" else value.present() & ~F.coalesce(near, F.lit(False))
    if op == "CONTAINS":
        own = _on_text(value, op, p.values[0], flags)
        if value.array() is None:
            return own
        return F.coalesce(value.array() & value.any_element(lambda v: v.equal(p.values[0])), F.lit(False)) | F.coalesce(own, F.lit(False))
    if op.startswith("NOT "):  # LIKE and REGEX: of strings only
        return ~_on_text(value, op[4:], p.values[0], flags)
    return _on_text(value, op, p.values[0], flags)


def _equality(records: Records, literal: Literal, flags: Flags, unequal: bool):
    def test(v: Value) -> Column:
        if isinstance(literal, Ref):
            other = records.value(literal.path, flags)
            same = v.equal_value(other)
        else:
            same = v.equal(literal)
        if not unequal:
            return same
        if isinstance(v, Typed) and v.number() is not None and isinstance(literal, float):
            return v.column.isNotNull() & ~same if v.flags.null_policy == "missing" else ~F.coalesce(same, F.lit(False))
        return v.present() & ~F.coalesce(same, F.lit(False))

    return test


def _ordered(records: Records, v: Value, op: str, literal: Literal, flags: Flags) -> Column:
    """Of numbers only; on the right also a field that is a number or spells one."""
    if v.number() is None:
        return F.lit(False)
    if isinstance(literal, Ref):
        right = records.value(literal.path, flags).as_bound()
        left = v.number()
        return F.lit(False) if right is None else {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    if isinstance(literal, float):
        return v.compare(op, literal)
    return F.lit(False)


def _between(records: Records, value: Value, bounds: tuple[Literal, ...], flags: Flags) -> Column:
    return value.any_element(lambda v: _ordered(records, v, ">=", bounds[0], flags) & _ordered(records, v, "<=", bounds[1], flags))


def _fuzzy(value: Value, literal: Literal, flags: Flags) -> Column:
    if not isinstance(literal, str):
        return F.lit(False)
    text = value.text()
    if value.array() is None:
        return F.lit(False) if text is None else fuzzy(text, literal, flags.case_sensitive)
    # a Python function can't stand in a lambda: the strings of the array are joined by a break that no token spans
    if isinstance(value, Typed):
        strings = value.column.cast("array<string>") if Typed(value.column, value.kind.elementType, flags).text() is not None else None
        return F.lit(False) if strings is None else _near_any(strings, literal, flags)
    strings = F.transform(value.column.try_cast("array<variant>"), lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")))
    return F.when(value.array(), _near_any(strings, literal, flags)).otherwise(fuzzy(text, literal, flags.case_sensitive))


def _near_any(strings: Column, literal: str, flags: Flags) -> Column:
    joined = F.array_join(strings, "\x00")
    if "\x00" in literal:
        return F.lit(False)
    return fuzzy(joined, literal, flags.case_sensitive)


def _on_text(value: Value, op: str, literal: Literal, flags: Flags) -> Column:
    text = value.text()
    if text is None or not isinstance(literal, str):
        return F.lit(None).cast("boolean")
    if op == "LIKE":
        return like(text, literal, flags.case_sensitive)
    if op == "REGEX":
        return text.rlike(java_pattern(literal, flags.case_sensitive))
    return holds(text, literal, flags.case_sensitive, op.lower())
