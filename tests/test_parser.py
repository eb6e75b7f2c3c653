"""What the language accepts and refuses, with messages and positions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from marlstone.plans import parser as P
from marlstone.plans.lexer import KEYWORDS, normalize
from marlstone.plans.syntax import Everything, Many, Not, Predicate, QueryError, Ref, SortKey, Term

REFUSED = {
    "price > -5": ("Unexpected character: -", 8),
    "hello world": ("Unexpected trailing input", 6),
    "123": ("Expected term, predicate, or '('", 0),
    "true": ("Expected term, predicate, or '('", 0),
    'name = "x': ("Unterminated string literal", 7),
    "name = 'x\\": ("Unterminated string literal", 7),
    "a NOT b": ("Expected IN after NOT", 6),
    'name REGEX "(a)+"': ("REGEX pattern rejected (potential ReDoS)", 17),
    'name REGEX "' + "a" * 257 + '"': ("REGEX pattern too long (max 256)", 270),
    'name REGEX "["': ("Invalid REGEX pattern", 0),
    'name REGEX "(?=a)b"': ("Invalid REGEX pattern", 0),
    "name REGEX 5": ("REGEX expects a string literal", 12),
    "price = 1.2.3": ("Invalid number", 8),
    "foo* = 1": ("Invalid field name", 0),
    "(a": ("Expected ')'", 2),
    "a ! b": ("Unexpected character: !", 2),
    "a <> 1": ("Expected value", 3),
    "a STARTS net": ("Expected WITH after STARTS", 9),
    "a ENDS": ("Expected WITH after ENDS", 6),
    "a IS 5": ("Expected NULL after IS", 5),
    "a IS NOT 5": ("Expected NULL after IS NOT", 9),
    "a IN b": ("Expected '(' after IN", 5),
    "a IN (b c)": ("Expected ',' or ')'", 8),
    "a BETWEEN (1 2)": ("Expected ',' in BETWEEN", 13),
    "a BETWEEN (1, 2": ("Expected ')' after BETWEEN", 15),
    "a BETWEEN 1 2": ("Expected AND in BETWEEN", 12),
    "SELECT 5": ("Expected field in SELECT", 7),
    "a CASE x": ("Expected SENSITIVE or INSENSITIVE after CASE", 7),
    "a ORDER x": ("Expected BY after ORDER", 8),
    "a ORDER BY 5": ("Expected field after ORDER BY", 11),
    "a ORDER BY b NULLS x": ("Expected FIRST or LAST after NULLS", 19),
    "a LIMIT x": ("Expected number after LIMIT", 8),
    "a OFFSET": ("Expected number after OFFSET", 8),
    "FUZZY 5": ("Expected term", 6),
    "(" * 101 + "a": ("Max nesting depth exceeded (100)", 101),
    "NOT " * 101 + "a": ("Max nesting depth exceeded (100)", 404),
    "ä" * 4097: ("Query length exceeds 8192 characters", 0),
}


@pytest.mark.parametrize("text", REFUSED, ids=lambda t: t[:24])
def test_refused(text):
    with pytest.raises(QueryError) as e:
        P.parse(text)
    assert (e.value.message, e.value.pos) == REFUSED[text]


def test_structure():
    q = P.parse("a OR b AND NOT c = 1")
    assert q.where == Many("or", (Term("a"), Many("and", (Term("b"), Not(Predicate("c", "=", (1.0,)))))))
    assert P.parse("a AND").where == Many("and", (Term("a"), Everything()))
    assert P.parse("").where == Everything() == P.parse("ORDER BY x").where
    assert P.parse("a = b").where == Predicate("a", "=", (Ref("b"),))
    assert P.parse("a LIKE b").where == Predicate("a", "LIKE", ("b",))
    assert P.parse(r"a = 'it\'s' ").where == Predicate("a", "=", ("it's",))
    assert [P.parse(t).where for t in ("net*", "*net", "*net*", "*", "a*b", '"x y*"', "**")] == [
        Term("net", "starts", False), Term("net", "ends", False), Term("net", "contains", False), Term("*"), Term("a*b"), Term("x y", "starts", False), Term("", "contains", False),
    ]


def test_clauses_in_any_order():
    q = P.parse("SELECT a, score WHERE x LIMIT 5 STRICT ORDER BY b DESC NULLS FIRST, SCORE OFFSET 2.9 CASE SENSITIVE LIMIT 7 ORDER BY c")
    assert q.select == ("a", "SCORE") and q.limit == 7 and q.offset == 2 and q.strict and q.case_sensitive and q.needs_score
    assert q.order == (SortKey("b", True, True), SortKey("SCORE"), SortKey("c"))
    assert P.parse("a CASE SENSITIVE CASE INSENSITIVE").case_sensitive is False


def test_extensions_are_off_unless_asked_for():
    assert P.parse("a > -5", signed=True).where == Predicate("a", ">", (-5.0,))
    with pytest.raises(QueryError):
        P.parse("`order` = 1")
    assert P.parse("`order` = 1", quoted_names=True).where == Predicate("order", "=", (1.0,))


def test_keywords_are_reserved():
    for k in KEYWORDS:
        with pytest.raises(QueryError):
            P.parse(f"{k} = 1" if k not in ("NOT", "FUZZY") else k + " )")


def test_normalize_and_validate():
    assert normalize("  a   =\t'x   y'  \n") == "a = 'x   y'"
    assert P.validate_query(" a  = 1") == {"ok": True, "normalized": "a = 1"}
    assert P.validate_query("a b")["error"] == {"message": "Unexpected trailing input", "pos": 2}


def test_cache():
    cache = P.QueryCache(2)
    first = cache.parse("a  = 1")
    assert cache.parse("a = 1") is first
    cache.parse("b")
    cache.parse("c")
    assert len(cache) == 2 and cache.parse("a = 1") is not first
    cache.resize(0)
    assert len(cache) == 1


@given(st.text(alphabet="ab =!<>()\"'*.,-19 \n", max_size=40) | st.lists(st.sampled_from(sorted(KEYWORDS) + ["a", "b.c", "'s'", "5", "(", ")", ",", "=", "WITH"]), max_size=12).map(" ".join))
def test_anything_is_parsed_or_refused(text):
    try:
        P.parse(text)
    except QueryError as e:
        assert e.pos >= 0
