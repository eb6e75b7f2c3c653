"""Text helpers as Column expressions: ASCII folding, tokens, number text, patterns."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: What parses as a 64-bit float; try_cast alone also takes blanks and type suffixes.
_FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)\z"
_FLOAT_PY = re.compile(r"(?i)[+-]?(inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)")


_LOWERED = {ord(c): c.lower() for c in _UPPER}


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWERED)


def fold(column: Column, case_sensitive: bool = False) -> Column:
    """ASCII lower case; other letters keep their case."""
    return column if case_sensitive else F.translate(column, _UPPER, _LOWER)


def folded(text: str, case_sensitive: bool = False) -> str:
    return text if case_sensitive else ascii_lower(text)


def equals(column: Column, text: str, case_sensitive: bool) -> Column:
    """Equality after folding, in a form that scans can take: raw equality where case can't differ, a short list of spellings for short texts."""
    letters = [c for c in text if c in string.ascii_letters]
    if case_sensitive or not letters:
        return column == F.lit(text)
    if len(letters) <= 3:
        spellings = [""]
        for c in text:
            spellings = [s + x for s in spellings for x in (sorted({c.lower(), c.upper()}) if c in string.ascii_letters else [c])]
        return column.isin(spellings)
    return fold(column) == F.lit(ascii_lower(text))


def parse_float(text: str) -> float | None:
    return float(text) if _FLOAT_PY.fullmatch(text) else None


def to_float(column: Column) -> Column:
    """The number that a whole text spells, null if none or not a number."""
    number = F.when(column.rlike(_FLOAT), column.try_cast("double"))
    return F.when(~F.isnan(number), number)


def number_text(column: Column, integral: bool) -> Column:
    """A number as JSON writes it: integers plainly, doubles with a fraction and without an exponent between 1e-5 and 1e16."""
    if integral:
        return column.cast("string")
    x = column.cast("double")
    plain = F.regexp_replace(F.regexp_replace(x.cast("string").cast("decimal(38,21)").cast("string"), "0+$", ""), "[.]$", ".0")
    exponent = F.regexp_replace(F.regexp_replace(F.lower(x.cast("string")), r"\.0e", "e"), r"\.0$", ".0")
    size = F.abs(x)
    return F.when((size == 0) | (size >= 1e-5) & (size < 1e16), plain).otherwise(exponent)


def tokens(column: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    # Unicode lower case differs within ASCII letters for two characters only: the Kelvin sign and the dotted capital I
    lower = F.when(column.rlike("[\u212a\u0130]"), fold(column)).otherwise(F.lower(column))
    return F.array_remove(F.split(lower, "[^a-z0-9]+"), "")


def tokenize(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", ascii_lower(text)) if t]


def _quoted(text: str) -> str:
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def holds(column: Column, text: str, case_sensitive: bool, where: str = "contains") -> Column:
    """Whether a text contains, starts with or ends with another, after folding. Java's ``(?i)`` folds ASCII letters only and spares a folded copy of the column."""
    if case_sensitive or not any(c in string.ascii_letters for c in text):
        return {"contains": Column.contains, "starts": Column.startswith, "ends": Column.endswith}[where](column, text)
    return column.rlike("(?i)" + {"contains": "{}", "starts": r"\A{}", "ends": r"{}\z"}[where].format(_quoted(text)))


def like(column: Column, pattern: str, case_sensitive: bool) -> Column:
    """% any run, _ any character, nothing escapes them; the whole text, line breaks included."""
    if case_sensitive:
        return F.like(column, F.lit(pattern), F.lit("\x01"))
    parts = re.split("(%+|_)", pattern)
    if len(parts) in (1, 3, 5) and all(p in ("", "%") or not set(p) & set("%_") for p in parts):  # no inner wild cards
        inner = [p for p in parts if p and p != "%"]
        if len(inner) == 1 and len(parts) > 1:
            where = "contains" if parts[0] == "" and parts[-1] == "" and len(parts) == 5 else "starts" if parts[-1] == "" else "ends"
            return holds(column, inner[0], case_sensitive, where)
    return column.rlike(r"(?is)\A" + "".join(".*" if p.startswith("%") else "." if p == "_" else _quoted(p) for p in parts) + r"\z")


#: The POSIX classes of ASCII characters.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\x00-\x7f", "blank": "\t ", "cntrl": "\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": "!-/:-@[-`{-~", "space": "\t\n\v\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Long names of general categories, and their codes.
CATEGORIES = {"letter": "L", "uppercase_letter": "Lu", "lowercase_letter": "Ll", "mark": "M", "number": "N", "decimal_number": "Nd", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C"}
_CODE = re.compile(r"[A-Z][a-z]?")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])")
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
_PROPERTY = re.compile(r"\\([pP])(?:\{(\^?)(?:(?:gc|sc|scx|Script|General_Category)=)?([A-Za-z_ -]+)\}|([A-Z]))")


class PatternError(ValueError):
    """A pattern that can't be said in java.util.regex."""


def _ranges(members: str, negated: bool) -> str:
    """A POSIX class, or its complement, as ranges of code points for within brackets."""
    pairs = [(ord(a or c), ord(b or c)) for a, b, c in re.findall("(.)-(.)|(.)", members, re.S)]
    if negated:
        edges = [-1, *(x for p in sorted(pairs) for x in p), 0x110000]
        pairs = [(a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if a + 1 <= b - 1]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in pairs)


def _property(m: re.Match) -> str:
    """A Unicode property by a name that Java knows."""
    name = m[3] or m[4]
    code = CATEGORIES.get(name.lower(), name)
    letter = m[1] if not m[2] else {"p": "P", "P": "p"}[m[1]]
    return rf"\{letter}{{{code if _CODE.fullmatch(code) else 'Is' + code.removeprefix('Is')}}}"


def java_pattern(pattern: str, case_sensitive: bool) -> str:
    """A pattern of the language in java.util.regex: Unicode classes, ``.`` for all but line feed, ``^`` and ``$`` for the very ends, or under the flag ``m`` for those of lines; POSIX classes within brackets."""
    out: list[str] = []
    lines = [False]  # whether ``m`` holds, for each open group
    depth, k, n = 0, 0, len(pattern)
    while k < n:
        c = pattern[k]
        if c == "\\" and k + 1 < n:
            if m := _PROPERTY.match(pattern, k):
                out.append(_property(m))
                k = m.end()
                continue
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if depth:
            if c == "[" and (m := _POSIX.match(pattern, k)):
                if m[2] not in POSIX:
                    raise PatternError(f"unknown class {m[2]}")
                out.append(_ranges(POSIX[m[2]], bool(m[1])))
                k = m.end()
                continue
            if pattern.startswith(("--", "~~"), k):
                raise PatternError("difference of classes")
            if c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
            out.append(c)
            k += 1
            if c == "[":
                k = _first(pattern, k, out)
            continue
        if c == "[":
            depth = 1
            out.append(c)
            k = _first(pattern, k + 1, out)
            continue
        if c == "(":
            m = _FLAGS.match(pattern, k)
            if m:
                on, off = m[1], m[2] or ""
                if set(on + off) - set("imsux"):
                    raise PatternError("unknown flag")
                inner = True if "m" in on else False if "m" in off else lines[-1]
                say = lambda f: f.replace("m", "").replace("u", "Uu")
                flags = say(on) + ("-" + say(off) if say(off) else "")
                if m[3] == ")":
                    lines[-1] = inner
                    out.append(f"(?{flags})" if flags else "")
                else:
                    lines.append(inner)
                    out.append(f"(?{flags}:")
                k = m.end()
                continue
            lines.append(lines[-1])
            if pattern.startswith("(?P<", k):
                out.append("(?<")
                k += 4
                continue
        elif c == ")" and len(lines) > 1:
            lines.pop()
        elif c == "$":
            c = r"(?=\n|\z)" if lines[-1] else r"\z"
        elif c == "^" and lines[-1]:
            c = r"(?:\A|(?<=\n))"
        out.append(c)
        k += 1
    return f"(?dU{'' if case_sensitive else 'iu'})" + "".join(out)


def _first(pattern: str, k: int, out: list[str]) -> int:
    """What follows an opening bracket: a caret, and a closing bracket that stands for itself."""
    if pattern.startswith("^", k):
        out.append("^")
        k += 1
    if pattern.startswith("]", k):
        out.append(r"\]")
        k += 1
    return k
