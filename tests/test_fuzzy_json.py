"""The fuzzy test of JSON records against its plain form, and how often it measures a distance."""

import json
import random
import re

import pytest

from marlstone.functions import freetext
from marlstone.functions import fuzzy as fz
from marlstone.functions.text import ascii_lower


def plain(source, term, case_sensitive):
    """Every scalar and key of a record by itself, with every token measured."""
    fold = (lambda s: s) if case_sensitive else ascii_lower
    t = fold(term)
    value = json.loads(source, parse_float=freetext._Number, parse_int=freetext._Number, parse_constant=freetext._Number)
    texts = [fold(s) for s in freetext._scalars(value, True)]
    return bool(t) and any(t in c or any(fz.near(t, w) for w in re.split("[^a-z0-9]+", ascii_lower(c)) if w) for c in texts)


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_records_match_as_their_texts(case_sensitive):
    r = random.Random(5)
    letters = "gizmoGZ ent10.é\n\"\\K"
    word = lambda n: "".join(r.choices(letters, k=r.randint(0, n)))
    value = lambda: r.choice([word(12), word(30), r.randint(-5, 99999), r.random() * 10.0 ** r.randint(-8, 20), True, None, [word(6), {word(7): 1e5}]])
    sources = [json.dumps({word(7): value() for _ in range(3)}, ensure_ascii=r.random() < 0.5) for _ in range(1_500)]
    sources += ['{"a": 1E5}', '{"a": 1000000000000000000000000}', '{"a": NaN, "b": -Infinity}', '{"gizmo": 1, "gizmo": "x"}', '{"a": "x", "a": "gizzmo"}', '{"a": "gi\\u007amo"}', '"gizmo"', "100000.0"]
    hits = 0
    for term in ("gizzmo", "Gizmo", "me", "to", "", "100000", "1e24", "infinite", "inf", "g", "zen tim"):
        test = freetext.json_fuzzy(term, case_sensitive)
        for s in sources:
            assert test(s) == plain(s, term, case_sensitive), (term, s)
            hits += test(s)
        assert not test(None)
    assert hits > 100


def test_tokens_are_measured_once(monkeypatch):
    """Records repeat their keys and words; numbers are told by their letters."""
    calls, distance = [0], fz.distance

    def counted(*a):
        calls[0] += 1
        return distance(*a)

    monkeypatch.setattr(fz, "distance", counted)
    test = freetext.json_fuzzy("gizzmo", False)
    found = [test(json.dumps({"size": k, "key": 100_000 + k, "name": f"{'gizmo' if k % 7 == 0 else 'bolt'} ring mogul"})) for k in range(2_000)]
    assert found == [k % 7 == 0 for k in range(2_000)]
    assert calls[0] <= 10
