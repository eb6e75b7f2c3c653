"""Query text to tokens, with one scanner pattern."""

from __future__ import annotations

import re
from typing import NamedTuple

from .syntax import QueryError

#: The reserved words of the language.
KEYWORDS = frozenset(
    "SELECT WHERE AND OR NOT FUZZY IN LIKE REGEX ORDER BY LIMIT OFFSET ASC DESC NULLS FIRST LAST SCORE CASE SENSITIVE INSENSITIVE STRICT BETWEEN CONTAINS STARTS ENDS EXISTS IS TRUE FALSE NULL".split()
)

_SCAN = re.compile(
    r"""(?P<space>\s+)
      | (?P<mark>[(),]|!=|>=|<=|[=><])
      | (?P<quoted>"(?:\\.|[^"\\]|\\(?=\Z))*"|'(?:\\.|[^'\\]|\\(?=\Z))*')
      | (?P<number>(?:[0-9]|\.(?=[0-9]))[0-9.]*)
      | (?P<word>[A-Za-z0-9_*][A-Za-z0-9_.*]*)
      | (?P<escaped>`[^`]+`)""",
    re.X | re.S,
)
_SIGNED = re.compile(r"-(?:[0-9]|\.(?=[0-9]))[0-9.]*")


class Token(NamedTuple):
    """kind: a mark, a keyword in capitals, or one of word, string, number, end."""

    kind: str
    value: str | float | None
    pos: int


def tokenize(text: str, signed: bool = False, quoted_names: bool = False) -> list[Token]:
    """``signed``: numbers may have a minus; ``quoted_names``: back-ticks make any text a field name. Both widen the language."""
    out: list[Token] = []
    at = 0
    while at < len(text):
        found = _SCAN.match(text, at)
        if signed and text[at] == "-" and (minus := _SIGNED.match(text, at)):
            out.append(Token("number", _number(minus[0], at), at))
            at = minus.end()
            continue
        kind = found.lastgroup if found else None
        if kind is None or kind == "escaped" and not quoted_names:
            if text[at] in "\"'":
                raise QueryError("Unterminated string literal", at)
            raise QueryError(f"Unexpected character: {text[at]}", at)
        piece = found[0]
        if kind == "mark":
            out.append(Token(piece, None, at))
        elif kind == "quoted":
            out.append(Token("string", re.sub(r"\\(.)", r"\1", piece[1:-1], flags=re.S), at))
        elif kind == "number":
            out.append(Token("number", _number(piece, at), at))
        elif kind == "escaped":
            out.append(Token("word", piece[1:-1], at))
        elif kind == "word":
            upper = piece.upper()
            out.append(Token(upper, None, at) if upper in KEYWORDS else Token("word", piece, at))
        at = found.end()
    out.append(Token("end", None, len(text.encode())))
    return out


def _number(piece: str, at: int) -> float:
    try:
        return float(piece)
    except ValueError:
        raise QueryError("Invalid number", at) from None


def normalize(text: str) -> str:
    """White space outside quotes becomes one space; the form that caches use."""
    parts = re.split(r"(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))", text)
    return "".join(p if k % 2 else re.sub(r"\s+", " ", p) for k, p in enumerate(parts)).strip()
