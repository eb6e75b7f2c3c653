"""The query language as data: literals, predicates, boolean nodes and a whole query."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Limits of the language.
MAX_QUERY_BYTES = 8192
MAX_DEPTH = 100
MAX_REGEX_BYTES = 256
MAX_ROWS = 1_000_000


class QueryError(ValueError):
    """A query that the language rejects; ``pos`` counts characters."""

    def __init__(self, message: str, pos: int = 0) -> None:
        super().__init__(f"Parse error at {pos}: {message}")
        self.message, self.pos = message, pos


@dataclass(frozen=True)
class Ref:
    """The value of another field of the record."""

    path: str


#: A literal: str, float, bool, None, or Ref.
Literal = str | float | bool | None | Ref


@dataclass(frozen=True)
class Predicate:
    path: str
    op: str
    values: tuple[Literal, ...] = ()


@dataclass(frozen=True)
class Term:
    """Free text: kind is contains, starts, ends or fuzzy."""

    text: str
    kind: str = "contains"
    #: Whether it was written without wild cards, so that it counts for ranking.
    plain: bool = True


@dataclass(frozen=True)
class Not:
    inner: Node


@dataclass(frozen=True)
class Many:
    """``and`` or ``or`` of several nodes."""

    kind: str
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Everything:
    pass


Node = Predicate | Term | Not | Many | Everything


@dataclass(frozen=True)
class SortKey:
    path: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def is_score(self) -> bool:
        return self.path.upper() == "SCORE"


@dataclass(frozen=True)
class Query:
    where: Node = field(default_factory=Everything)
    select: tuple[str, ...] | None = None
    order: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int = 0
    case_sensitive: bool = False
    strict: bool = False

    @property
    def needs_score(self) -> bool:
        return any(p.upper() == "SCORE" for p in self.select or ()) or any(k.is_score for k in self.order)


def walk(node: Node):
    """The node and all below it, in order."""
    yield node
    for part in node.parts if isinstance(node, Many) else (node.inner,) if isinstance(node, Not) else ():
        yield from walk(part)
