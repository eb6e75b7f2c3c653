"""Boolean structure to one filter Column.

NOT is pushed down to the leaves, so that a null test (no match) never meets a negation and positive comparisons reach the
scan as they are. Conjuncts and disjuncts are ordered by cost: comparisons first, texts, patterns, Python last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.freetext import term
from ..functions.predicates import predicate
from ..functions.values import Flags, Records
from .syntax import Everything, Many, Node, Not, Predicate, Term

#: Relative costs of leaves; what isn't named costs 3.
_COST = {"=": 1, "IN": 2, "EXISTS": 1, "IS NULL": 1, "IS NOT NULL": 1, "LIKE": 6, "NOT LIKE": 6, "CONTAINS": 5, "STARTS": 5, "ENDS": 5, "REGEX": 9, "NOT REGEX": 9, "FUZZY": 20, "NOT FUZZY": 20}


def cost(node: Node) -> int:
    if isinstance(node, Predicate):
        return _COST.get(node.op, 3)
    if isinstance(node, Term):
        return 30 if node.kind == "fuzzy" else 15
    if isinstance(node, Not):
        return 1 + cost(node.inner)
    return max(map(cost, node.parts)) + 1 if isinstance(node, Many) else 0


def lower(node: Node, records: Records, flags: Flags, negated: bool = False) -> Column:
    if isinstance(node, Everything):
        return F.lit(not negated)
    if isinstance(node, Not):
        return lower(node.inner, records, flags, not negated)
    if isinstance(node, Many):
        parts = [lower(p, records, flags, negated) for p in sorted(node.parts, key=cost)]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if (node.kind == "and") != negated else out | p
        return out
    if isinstance(node, Term):
        found = term(records, node.text, node.kind, flags)
        return ~F.coalesce(found, F.lit(False)) if negated else found
    return predicate(records, node, flags, negated)
