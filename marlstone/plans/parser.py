"""Tokens to a query, by recursive descent over small tables of operators and clauses."""

from __future__ import annotations

import re
import warnings
from collections import OrderedDict
from threading import Lock

from ..functions.text import PatternError, java_pattern
from .lexer import Token, normalize, tokenize
from .syntax import MAX_DEPTH, MAX_QUERY_BYTES, MAX_REGEX_BYTES, Everything, Literal, Many, Node, Not, Predicate, Query, QueryError, Ref, SortKey, Term, walk

_COMPARE = {"=", "!=", ">", ">=", "<", "<="}
#: First token of what follows a field in a predicate.
_AFTER_FIELD = _COMPARE | {"IN", "LIKE", "REGEX", "FUZZY", "NOT", "BETWEEN", "CONTAINS", "STARTS", "ENDS", "EXISTS", "IS"}
_CLAUSES = {"ORDER", "LIMIT", "OFFSET", "CASE", "STRICT"}
#: Parts of patterns that the language refuses, and constructs that its patterns don't have.
_RISKY = (")+", ")*", "){", "++", "**", "{,")
_FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]")
_POSIX_CLASS = re.compile(r"\[:\^?[a-z]+:\]")


class _Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at, self.depth = tokens, 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[min(self.at, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.now
        self.at += 1
        return token

    def accept(self, *kinds: str) -> Token | None:
        return self.take() if self.now.kind in kinds else None

    def need(self, kind: str, message: str) -> Token:
        return self.accept(kind) or self.fail(message)

    def fail(self, message: str) -> Token:
        raise QueryError(message, self.now.pos)

    def nest(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail(f"Max nesting depth exceeded ({MAX_DEPTH})")

    # boolean structure

    def either(self, kind: str = "OR") -> Node:
        below = (lambda: self.either("AND")) if kind == "OR" else self.negated
        parts = [below()]
        while self.accept(kind):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Many(kind.lower(), tuple(parts))

    def negated(self) -> Node:
        if not self.accept("NOT"):
            return self.primary()
        self.nest()
        inner = self.negated()
        self.depth -= 1
        return Not(inner)

    def primary(self) -> Node:
        kind = self.now.kind
        if kind == "end":
            return Everything()
        if self.accept("("):
            self.nest()
            inner = self.either()
            self.depth -= 1
            self.need(")", "Expected ')'")
            return inner
        if self.accept("FUZZY"):
            word = self.take()
            if word.kind not in ("word", "string"):
                raise QueryError("Expected term", word.pos)
            return Term(word.value, "fuzzy", plain=False)
        if kind == "word" and self.tokens[self.at + 1].kind in _AFTER_FIELD:
            return self.predicate()
        if kind in ("word", "string"):
            return _term(self.take().value)
        return self.fail("Expected term, predicate, or '('")

    # predicates

    def predicate(self) -> Predicate:
        name = self.take()
        if not re.fullmatch(r"[A-Za-z0-9_.]+", name.value):
            raise QueryError("Invalid field name", name.pos)
        op = self.operator()
        return Predicate(name.value, op, self.operands(op))

    def operator(self) -> str:
        kind = self.take().kind
        if kind == "NOT":
            return "NOT " + (self.accept("LIKE", "REGEX", "FUZZY") or self.need("IN", "Expected IN after NOT")).kind
        if kind in ("STARTS", "ENDS"):
            if self.now.kind != "word" or self.now.value.upper() != "WITH":
                self.fail(f"Expected WITH after {kind}")
            self.take()
        if kind == "IS":
            if self.accept("NOT"):
                self.need("NULL", "Expected NULL after IS NOT")
                return "IS NOT NULL"
            self.need("NULL", "Expected NULL after IS")
            return "IS NULL"
        return kind

    def operands(self, op: str) -> tuple[Literal, ...]:
        if op in ("EXISTS", "IS NULL", "IS NOT NULL"):
            return ()
        if op in _COMPARE:
            return (self.value(refs=True),)
        if op == "BETWEEN":
            return self.bounds()
        if op in ("IN", "NOT IN"):
            return self.listed()
        value = self.value()
        if op in ("REGEX", "NOT REGEX"):
            if not isinstance(value, str):
                self.fail("REGEX expects a string literal")
            _check_regex(value, self.now.pos)
        return (value,)

    def value(self, refs: bool = False) -> Literal:
        token = self.take()
        if token.kind == "word":
            return Ref(token.value) if refs else token.value
        if token.kind in ("string", "number"):
            return token.value
        if token.kind in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[token.kind]
        raise QueryError("Expected value", token.pos)

    def bounds(self) -> tuple[Literal, Literal]:
        if self.accept("("):
            low = self.value(refs=True)
            self.need(",", "Expected ',' in BETWEEN")
            high = self.value(refs=True)
            self.need(")", "Expected ')' after BETWEEN")
        else:
            low = self.value(refs=True)
            self.need("AND", "Expected AND in BETWEEN")
            high = self.value(refs=True)
        return low, high

    def listed(self) -> tuple[Literal, ...]:
        self.need("(", "Expected '(' after IN")
        if self.accept(")"):
            return ()
        values = [self.value()]
        while self.accept(","):
            values.append(self.value())
        self.need(")", "Expected ',' or ')'")
        return tuple(values)

    # clauses

    def names(self, message: str) -> str:
        if self.accept("SCORE"):
            return "SCORE"
        return self.need("word", message).value

    def sort_keys(self) -> list[SortKey]:
        self.need("BY", "Expected BY after ORDER")
        keys = []
        while True:
            path = self.names("Expected field after ORDER BY")
            direction = self.accept("ASC", "DESC")
            first = None
            if self.accept("NULLS"):
                first = (self.accept("FIRST", "LAST") or self.fail("Expected FIRST or LAST after NULLS")).kind == "FIRST"
            keys.append(SortKey(path, direction is not None and direction.kind == "DESC", first))
            if not self.accept(","):
                return keys

    def query(self) -> Query:
        select, where = None, Everything()
        if self.accept("SELECT"):
            select = [self.names("Expected field in SELECT")]
            while self.accept(","):
                select.append(self.names("Expected field in SELECT"))
            if self.accept("WHERE"):
                where = self.either()
        elif self.now.kind not in _CLAUSES | {"end"}:
            where = self.either()
        order: list[SortKey] = []
        found: dict = {}
        while clause := self.accept(*_CLAUSES):
            if clause.kind == "ORDER":
                order += self.sort_keys()
            elif clause.kind == "STRICT":
                found["strict"] = True
            elif clause.kind == "CASE":
                mode = self.accept("SENSITIVE", "INSENSITIVE") or self.fail("Expected SENSITIVE or INSENSITIVE after CASE")
                found["case_sensitive"] = mode.kind == "SENSITIVE"
            else:
                number = self.need("number", f"Expected number after {clause.kind}").value
                if number < 0:
                    self.fail(f"{clause.kind} must be non-negative")
                found[clause.kind.lower()] = int(number)
        if self.now.kind != "end":
            self.fail("Unexpected trailing input")
        return Query(where, tuple(select) if select is not None else None, tuple(order), **found)


def _term(text: str) -> Term:
    """A star at an end of a word is a wild card, a star elsewhere or alone is not."""
    if len(text.encode()) > 1:
        before, after = text.startswith("*"), text.endswith("*")
        if before and after:
            return Term(text[1:-1], "contains", plain=False)
        if before:
            return Term(text[1:], "ends", plain=False)
        if after:
            return Term(text[:-1], "starts", plain=False)
    return Term(text)


def _check_regex(pattern: str, pos: int) -> None:
    if len(pattern.encode()) > MAX_REGEX_BYTES:
        raise QueryError(f"REGEX pattern too long (max {MAX_REGEX_BYTES})", pos)
    if any(r in pattern for r in _RISKY):
        raise QueryError("REGEX pattern rejected (potential ReDoS)", pos)


def _check_dialect(pattern: str) -> None:
    """Patterns have neither look-around nor back-references; the rest is compiled here so that an error shows before a job runs."""
    try:
        if _FOREIGN.search(pattern):
            raise re.error("not in the dialect")
        java_pattern(pattern, True)
        plain = _POSIX_CLASS.sub("a-z", re.sub(r"\\[pP](?:\{[^}]*\}|.)", ".", pattern.replace(r"\z", r"\Z")))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # of nested classes
            re.compile(re.sub(r"\(\?[imsux]*(?:-[imsux]+)?\)", "", plain).replace("(?<", "(?P<"))
    except (re.error, PatternError):
        raise QueryError("Invalid REGEX pattern", 0) from None


def parse(text: str, signed: bool = False, quoted_names: bool = False) -> Query:
    """Parse without the cache."""
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise QueryError(f"Query length exceeds {MAX_QUERY_BYTES} characters", 0)
    parser = _Parser(tokenize(text, signed, quoted_names))
    query = parser.query()
    for node in walk(query.where):
        if isinstance(node, Predicate) and node.op in ("REGEX", "NOT REGEX"):
            _check_dialect(node.values[0])
    return query


class QueryCache:
    """Parsed queries by normalised text, the least recently used one goes first."""

    def __init__(self, capacity: int = 512) -> None:
        self._capacity, self._held, self._lock = capacity, OrderedDict(), Lock()

    def resize(self, capacity: int) -> None:
        with self._lock:
            self._capacity = max(1, capacity)
            while len(self._held) > self._capacity:
                self._held.popitem(last=False)

    def parse(self, text: str, **options) -> Query:
        key = (normalize(text), *sorted(options.items()))
        with self._lock:
            if key in self._held:
                self._held.move_to_end(key)
                return self._held[key]
        query = parse(key[0], **options)
        with self._lock:
            self._held[key] = query
            while len(self._held) > self._capacity:
                self._held.popitem(last=False)
        return query

    def __len__(self) -> int:
        return len(self._held)


QUERIES = QueryCache()


def set_query_cache_size(capacity: int) -> None:
    QUERIES.resize(capacity)


def validate_query(text: str, **options) -> dict:
    """``{"ok": True, "normalized": ...}`` or ``{"ok": False, "error": {"message", "pos"}}``; leaves the cache alone."""
    try:
        parse(normalize(text), **options)
    except QueryError as e:
        return {"ok": False, "error": {"message": e.message, "pos": e.pos}}
    return {"ok": True, "normalized": normalize(text)}
