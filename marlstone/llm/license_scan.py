"""Licence recognition by sentence rules.

A text is cut into sentences; each is normalised (ASCII lower case, ``licence`` spelled ``license``, comment marks and punctuation gone) and
mapped to the identifier of a known licence sentence, if it is one. Rules, tried in their order from each place on, match sequences of
identifiers; sentences that are not known end a sequence, neutral ones (copyright lines) don't. A sentence that grants a licence by
name, or an SPDX tag, has the name in its identifier; the last rules of the table are for these.

Null and empty texts have no licence; an empty table gives no rows. Sentences of unlimited length are read whole. Repeated rows each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.spread import spread
from .license_tables import GRANT, LATER, NAMES, NEUTRAL, RULES, SENTENCES

#: ``v. 2.0`` is one word of a name, not the end of a sentence.
_SENTENCE = re.compile(r"(?<=[.!?;])(?!(?<=\b[vV]\.)\s+\d)\s+|\n\s*\n|:\s*\n")
_NUMBER = re.compile(r"\W*\w{0,3}\W*")
_TAG = re.compile(r"spdx-license-identifier:\s*([\w.+()-]+(?: (?:or|and|with) [\w.+()-]+)*)", re.I)
_NOISE = re.compile(r"[^a-z0-9]+")
_MARKS = re.compile(r"^[ \t]*(?://+|/\*+|\*+/?|#+|;+|--+|%+|<!--)[ \t]*", re.M)


def normalise(sentence: str) -> str:
    return _NOISE.sub(" ", sentence.translate(_LOWER)).replace("licence", "license").strip()


_LOWER = {c: c + 32 for c in range(65, 91)}


@cache
def _patterns() -> tuple[re.Pattern, list[tuple[str, re.Pattern, str]], re.Pattern]:
    """Names of licences (a group for each), sentences with gaps (over words, each before a blank) after the longest literal they need, copyright lines."""
    names = re.compile("|".join(rf"(?P<n{k}>\b(?:{re.sub('[?]P<[a-z]>', '?:', p)})\b)" for k, p in enumerate(NAMES.values())))
    gap = lambda s: "".join(r"(?:\S+ ){0,12}?" if w == "*" else re.escape(w) + " " for w in s.split())
    need = lambda s: max((x.strip() for x in s.split("*")), key=len)
    return names, [(need(s), re.compile(gap(s)), k) for k, s in SENTENCES.items() if "*" in s], re.compile(r"(?:copyright|c) (?:copyright |c )*\d{4}.*|copyright .{0,80}|portions copyright .*")


_GRANT = re.compile(GRANT)
_GRANT_END = re.compile(GRANT + r"\Z")
#: The words that grants begin with.
_VERBS = re.search(r"\(\?:(.*?)\)", GRANT)[1].split("|")


def _grant(sentence: str) -> str | None:
    """The licence by whose name a sentence grants, or whose title it is."""
    if "license" not in sentence and not (any(v in sentence for v in _VERBS) and _GRANT.search(sentence)) or " not " in sentence:
        return None  # neither a title nor a grant
    for m in _patterns()[0].finditer(sentence):
        title = m.start() == (4 if sentence.startswith("the ") else 0) and sentence[m.end() :] in ("", " license") and "license" in sentence
        if title or _GRANT_END.search(sentence, max(0, m.start() - 120), m.start()):
            name, pattern = list(NAMES.items())[int(m.lastgroup[1:])]
            version = re.fullmatch(pattern, m[0])
            number = next((v for v in version.groupdict().values() if v), "") if version else ""
            later = re.match(LATER, sentence[m.end() :])
            return f"grant:{name}" + (f"-{number.replace(' ', '.')}" if number else "") + ("-or-later" if later else "")
    return None


def identify(sentence: str) -> str | None:
    """Identifier of a normalised sentence; takes time in proportion to its length."""
    known = _exact().get(sentence) or _grant(sentence)
    if known:
        return known
    _, gaps, owner = _patterns()
    return next((k for need, p, k in gaps if need in sentence and p.fullmatch(sentence + " ")), "copyright" if owner.fullmatch(sentence) else None)


@cache
def _exact() -> dict[str, str]:
    return {s: k for k, s in SENTENCES.items() if "*" not in s}


def sequence(text: str) -> list[str | None]:
    """Identifiers of the sentences, None for unknown ones; an SPDX tag gives ``spdx:`` and its expression."""
    out: list[str | None] = []
    for part in _SENTENCE.split(_MARKS.sub("", text)):
        if _NUMBER.fullmatch(part):  # numbers of list items are no sentences
            continue
        if tag := _TAG.search(part):
            out.append("spdx:" + " ".join(tag[1].split()))
            continue
        found = identify(normalise(part))
        if found is None and "\n" in part:  # a heading may stand on a line of its own, without a full stop
            lines = [identify(normalise(x)) for x in part.split("\n")]
            whole = identify(normalise(part.split("\n", 1)[1])) if lines[0] else None
            out += [lines[0], whole] if whole else lines
        else:
            out.append(found)
    return out


def _match(ids: list[str | None], at: int, rule: tuple[str, ...]) -> int:
    """Where the rule's sequence ends, or ``at`` if it doesn't match there."""
    k, some = at, False
    for want in rule:
        j = k
        while j < len(ids) and some and ids[j] in NEUTRAL:
            j += 1
        have = ids[j] if j < len(ids) else None
        if have is not None and _meets(have, want.rstrip("?")):
            k, some = j + 1, True
        elif not want.endswith("?"):
            return at
    return k


def _meets(have: str, want: str) -> bool:
    return have.startswith(want[:-1]) if want.endswith("*") else have == want


def licences(ids: list[str | None]) -> list[str]:
    """Licences that the rules find, in their order in the text."""
    out, at = [], 0
    while at < len(ids):
        here = ids[at]
        step = at + 1
        if here is not None and here not in NEUTRAL:
            for name, rule in RULES:
                end = _match(ids, at, rule)
                if end > at:
                    out.append(name or here.split(":", 1)[1])
                    step = end
                    break
        at = step
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids, names = [], [], []
        for t in batch.column("text"):
            text = t.as_py()
            found = sequence(text) if text else []
            known = [x for x in found if x]
            n.append(len(known))
            ids.append(",".join(known))
            names.append(",".join(dict.fromkeys(licences(found))))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array([bool(x) for x in names])], ["id", "n_sentences", "sentence_ids", "licenses", "licensed"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_sentences (known ones), sentence_ids (in order), licenses (in order, each once), licensed."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"id {id_type}, n_sentences long, sentence_ids string, licenses string, licensed boolean").withColumnRenamed("id", id_col)
