"""Patterns of the language against what they must match; java.util.regex does the matching."""

import pytest

from marlstone.functions.text import PatternError, java_pattern
from marlstone.operators.search import Dataset, search
from marlstone.plans.parser import parse
from marlstone.plans.syntax import QueryError

TEXTS = ["123", "d", "abc", "ABC", "x\nabc\ny", "abc\n", "a]b", "é9", "Ωmega", "", "tab\there", "--"]
CASES = {
    "^[[:digit:]]+$": {"123"},
    "[[:alpha:]]{3}": {"abc", "ABC", "x\nabc\ny", "abc\n", "Ωmega", "tab\there"},
    "(?m)^abc$": {"abc", "x\nabc\ny", "abc\n"},
    "^abc$": {"abc"},
    "(?m:^abc)$": {"abc"},
    "(?m)^$": {"abc\n", ""},
    "[[:^ascii:]]": {"é9", "Ωmega"},
    "[^[:^digit:]]": {"123", "é9"},
    "[]]": {"a]b"},
    "^\\p{Greek}": {"Ωmega"},
    "^\\p{Uppercase_Letter}{3}$": {"ABC"},
    "[[:blank:]]": {"tab\there"},
    "^[[:punct:]]+$": {"--"},
    "b(?i)C$": {"abc"},
    "^.+$": {"123", "d", "abc", "ABC", "a]b", "é9", "Ωmega", "tab\there", "--"},
}


@pytest.fixture(scope="module")
def table(spark):
    return Dataset(spark.createDataFrame([(t,) for t in TEXTS], "s string"))


@pytest.mark.parametrize("pattern", CASES)
def test_matches(table, pattern):
    quoted = pattern.replace("\\", "\\\\")
    assert {r["s"] for r in search(table, f's REGEX "{quoted}" CASE SENSITIVE').collect()} == CASES[pattern]


@pytest.mark.parametrize("pattern", ["[[:nope:]]", "(?R)a", "[a--b]", "(?=a)", "(?U)a", "[a~~b]"])
def test_what_java_cannot_say_is_refused(pattern):
    with pytest.raises(QueryError, match="Invalid REGEX pattern"):
        parse(f's REGEX "{pattern}"')


def test_error():
    with pytest.raises(PatternError):
        java_pattern("[[:nope:]]", True)
