"""Fuzzy matching: substring, else a token within a bound of the unrestricted Damerau-Levenshtein distance."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded, holds, tokens


def bound(term: str) -> int:
    """Distance that a term allows, by its bytes."""
    n = len(term.encode())
    return 0 if n < 3 else 1 if n <= 4 else 2 if n <= 7 else 3


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance in which transposed letters may be edited further; ``most + 1`` if the lengths alone rule it out."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, match = [i], 0
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            p = last.get(y, 0)
            if p and match:
                best = min(best, rows[p - 1][match - 1] + (i - p - 1) + 1 + (j - match - 1))
            if x == y:
                match = j
            row.append(best)
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


def near(term: str, token: str) -> bool:
    if len(term.encode()) < 3 or len(token.encode()) < 3:
        return term == token
    return distance(term, token, bound(term)) <= bound(term)


def nearby(term: str) -> Callable[[str], bool]:
    """``near`` for many tokens: remembers them, and tells most that aren't near by their letters, since each one that the term lacks takes an edit."""
    most, own = bound(term), dict.fromkeys(map(ord, term))

    @lru_cache(100_000)
    def known(token: str) -> bool:
        return len(token.translate(own)) <= most and near(term, token)

    return known


_TOKEN = re.compile("[a-z0-9]+")


def holds_near(text: str, term: str, known: Callable[[str], bool], case_sensitive: bool) -> bool:
    """Whether a text has a folded term, or a token that ``known`` takes for near."""
    c = folded(text, case_sensitive)
    return bool(term) and (term in c or any(map(known, _TOKEN.findall(folded(c)))))


def matches(text: str, term: str, case_sensitive: bool) -> bool:
    """Plain Python form, for records that are only known as JSON."""
    t = folded(term, case_sensitive)
    return holds_near(text, t, nearby(t), case_sensitive)


def fuzzy(column: Column, term: str, case_sensitive: bool) -> Column:
    """As ``matches``; texts that the cheap tests decide don't reach Python."""
    t = folded(term, case_sensitive)
    if not t:
        return F.lit(False) & column.isNotNull()
    contains = holds(column, t, case_sensitive)
    most = bound(t)
    if not most:
        return contains | F.array_contains(tokens(column), t)
    # the plain distance is at most twice this one
    candidate = F.exists(tokens(column), lambda w: F.levenshtein(w, F.lit(t), 2 * most) >= 0)
    hard = F.when(~contains & candidate, column)

    @F.pandas_udf("boolean")
    def close(texts: pd.Series) -> pd.Series:
        known = nearby(t)
        return texts.map(lambda s: s is not None and any(map(known, _TOKEN.findall(folded(s))))).astype(bool)

    return contains | F.coalesce(close(hard), F.lit(False))
