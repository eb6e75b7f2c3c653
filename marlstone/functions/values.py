"""What a path means in a record: typed columns and VARIANT values behind one interface.

Each value answers the questions that predicates ask, as Columns that are true for a match and false *or null* otherwise; the caller
wraps what it negates. Typed columns are resolved against the schema when the plan is built, so that a comparison
that the type rules out becomes a constant and the rest reaches the scan as plain comparisons.

An SQL NULL in a typed column is an absent field (policy "missing", the default) or a JSON null ("json_null").
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import equals, fold, parse_float, to_float

Elementwise = Callable[["Value"], Column]


@dataclass(frozen=True)
class Flags:
    case_sensitive: bool = False
    strict: bool = False
    null_policy: str = "missing"


class Value:
    """A field's value in each record."""

    flags: Flags

    def present(self) -> Column: ...
    def null(self) -> Column:
        """A JSON null (present)."""

    def text(self) -> Column | None:
        """The string, null for others; None if it can't be one."""

    def number(self) -> Column | None: ...
    def truth(self) -> Column | None: ...
    def array(self) -> Column | None:
        """Whether it is an array; None if it can't be."""

    def some(self, test: Elementwise) -> Column:
        """Whether any element passes."""

    def compare(self, op: str, x: float) -> Column:
        """Ordered or equal comparison of a number with a constant."""

    def equal(self, literal) -> Column:
        """A scalar equal to a literal other than a field, by the rules of coercion."""
        none = F.lit(False)
        if literal is None:
            return self.null()
        if isinstance(literal, bool):
            own = self.truth()
            return none if own is None else own == F.lit(literal)
        tests = []
        text = self.text()
        if isinstance(literal, str):
            x = None if self.flags.strict else parse_float(literal)
            if text is not None:
                tests.append(equals(text, literal, self.flags.case_sensitive))
        else:
            x = literal
            if text is not None and not self.flags.strict:
                tests.append(to_float(text) == F.lit(float(x)))
        if x is not None and not math.isnan(x) and self.number() is not None:
            tests.append(self.compare("=", x))
        return _any(tests)

    def equal_value(self, other: Value) -> Column:
        """Equal to another scalar field."""
        a, b, tests = self, other, []
        if a.text() is not None and b.text() is not None:
            tests.append(fold(a.text(), self.flags.case_sensitive) == fold(b.text(), self.flags.case_sensitive))
        if a.number() is not None and b.number() is not None:
            tests.append(a.number() == b.number())
        if a.truth() is not None and b.truth() is not None:
            tests.append(a.truth() == b.truth())
        tests.append(a.null() & b.null())
        if not self.flags.strict:
            tests += [to_float(p.text()) == q.number() for p, q in ((a, b), (b, a)) if p.text() is not None and q.number() is not None]
        return _any(tests)

    def as_bound(self) -> Column | None:
        """The number that it stands for on the right of a comparison."""
        parts = [p for p in (self.number(), None if self.flags.strict or self.text() is None else to_float(self.text())) if p is not None]
        return F.coalesce(*parts) if parts else None

    def any_element(self, test: Elementwise) -> Column:
        """The test on a scalar, or on any element of an array."""
        is_array = self.array()
        if is_array is None:
            return test(self)
        return F.when(is_array, self.some(test)).otherwise(test(self))


def _any(tests: list[Column]) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out | t
    return F.lit(False) if out is None else out


class Missing(Value):
    """A path that no record has."""

    def __init__(self, flags: Flags) -> None:
        self.flags = flags

    def present(self) -> Column:
        return F.lit(False)

    null = present

    def text(self) -> None:
        return None

    number = truth = array = text


class Typed(Value):
    def __init__(self, column: Column, kind: T.DataType, flags: Flags) -> None:
        self.column, self.kind, self.flags = column, kind, flags

    def present(self) -> Column:
        return F.lit(True) if self.flags.null_policy == "json_null" else self.column.isNotNull()

    def null(self) -> Column:
        return self.column.isNull() if self.flags.null_policy == "json_null" else F.lit(False)

    def text(self) -> Column | None:
        if isinstance(self.kind, T.StringType | T.VarcharType | T.CharType):
            return self.column
        if isinstance(self.kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            return self.column.cast("string")
        return None

    def number(self) -> Column | None:
        return self.column.cast("double") if isinstance(self.kind, T.NumericType) else None

    def truth(self) -> Column | None:
        return self.column if isinstance(self.kind, T.BooleanType) else None

    def array(self) -> Column | None:
        return self.column.isNotNull() if isinstance(self.kind, T.ArrayType) else None

    def some(self, test: Elementwise) -> Column:
        inner = Flags(self.flags.case_sensitive, self.flags.strict, "json_null")  # a null element is there
        return F.exists(self.column, lambda e: F.coalesce(test(Typed(e, self.kind.elementType, inner)), F.lit(False)))

    def any_element(self, test: Elementwise) -> Column:
        return self.some(test) if isinstance(self.kind, T.ArrayType) else test(self)

    def compare(self, op: str, x: float) -> Column:
        c = self.column
        if isinstance(self.kind, T.IntegralType) and abs(x) < 2**53:
            if x != int(x):  # between two integers
                if op == "=":
                    return F.lit(False) & c.isNotNull()
                x, op = (math.floor(x), ">") if op in (">", ">=") else (math.ceil(x), "<")
            x = int(x)
            edge = {T.ByteType: 2**7, T.ShortType: 2**15, T.IntegerType: 2**31}.get(type(self.kind))
            if edge and not -edge <= x < edge:
                always = op in (">", ">=") and x < 0 or op in ("<", "<=") and x > 0
                return c.isNotNull() if always else F.lit(False) & c.isNotNull()
            right = F.lit(x).cast(self.kind)
        else:
            c, right = (c if isinstance(self.kind, T.DoubleType) else c.cast("double")), F.lit(float(x))
        out = {"=": c == right, ">": c > right, ">=": c >= right, "<": c < right, "<=": c <= right}[op]
        return out & ~F.isnan(c) if isinstance(self.kind, T.FractionalType) and op in (">", ">=") and not isinstance(self.kind, T.DecimalType) else out


class Variant(Value):
    """A VARIANT value; ``column`` is null where the path is missing."""

    def __init__(self, column: Column, flags: Flags) -> None:
        self.column, self.flags = column, flags
        self.kind = F.schema_of_variant(column)

    def present(self) -> Column:
        return self.column.isNotNull()

    def null(self) -> Column:
        return self.kind == "VOID"

    def text(self) -> Column:
        return F.when(self.kind == "STRING", F.try_variant_get(self.column, "$", "string"))

    def number(self) -> Column:
        return F.when(self.kind.isin("BIGINT", "DOUBLE") | self.kind.startswith("DECIMAL"), F.try_variant_get(self.column, "$", "double"))

    def truth(self) -> Column:
        return F.when(self.kind == "BOOLEAN", F.try_variant_get(self.column, "$", "boolean"))

    def array(self) -> Column:
        return self.kind.startswith("ARRAY")

    def some(self, test: Elementwise) -> Column:
        return F.exists(self.column.try_cast("array<variant>"), lambda e: F.coalesce(test(Variant(e, self.flags)), F.lit(False)))

    def compare(self, op: str, x: float) -> Column:
        c, right = self.number(), F.lit(float(x))
        return {"=": c == right, ">": c > right, ">=": c >= right, "<": c < right, "<=": c <= right}[op]


def variant_path(segments: list[str]) -> str:
    """Numbers index arrays, all else names a key."""
    return "$" + "".join(f"[{s}]" if re.fullmatch(r"[0-9]+", s) else f"['{s}']" for s in segments)


@dataclass(frozen=True)
class Records:
    """How the records of a DataFrame are held: one VARIANT column, or typed columns (of which some may be VARIANT)."""

    schema: T.StructType
    record: str | None = None
    #: Columns that are not fields.
    hidden: tuple[str, ...] = ("_row_id",)

    def fields(self) -> list[T.StructField]:
        return [f for f in self.schema.fields if f.name not in self.hidden]

    def value(self, path: str, flags: Flags) -> Value:
        segments = path.split(".")
        if self.record:
            return Variant(F.variant_get(F.col(self.record), variant_path(segments), "variant"), flags)
        for n in range(len(segments), 0, -1):  # a column's name may hold dots
            name = ".".join(segments[:n])
            found = next((f for f in self.fields() if f.name == name), None)
            if found:
                return descend(F.col(f"`{name}`"), found.dataType, segments[n:], flags)
        return Missing(flags)


def descend(column: Column, kind: T.DataType, segments: list[str], flags: Flags) -> Value:
    for k, s in enumerate(segments):
        if isinstance(kind, T.VariantType):
            return Variant(F.variant_get(column, variant_path(segments[k:]), "variant"), flags)
        if isinstance(kind, T.StructType):
            inner = next((f for f in kind.fields if f.name == s), None)
            if inner is None:
                return Missing(flags)
            column, kind = column.getField(s), inner.dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            column, kind = F.try_element_at(column, F.lit(s)), kind.valueType
        elif isinstance(kind, T.ArrayType) and s.isascii() and s.isdigit():
            column, kind = F.get(column, F.lit(int(s))), kind.elementType
        else:
            return Missing(flags)
    return Variant(column, flags) if isinstance(kind, T.VariantType) else Typed(column, kind, flags)
