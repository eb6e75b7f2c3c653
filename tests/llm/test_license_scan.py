import itertools
import random
import re
import time

import pytest

from marlstone.llm.license_scan import licences, scan, sequence
from marlstone.llm.license_tables import GRANT, NAMES, NEUTRAL, RULES, SENTENCES

MIT = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + ". ".join(SENTENCES[k].upper() for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")) + "."
BSD = "Copyright 2019, X.\nAll rights reserved.\n\n" + f"{SENTENCES['bsd-grant']}:\n\n1. {SENTENCES['bsd-source'][2:]}.\n2. {SENTENCES['bsd-binary'][2:]}.\n"
CASES = {
    MIT: ["MIT"],
    BSD: ["BSD-2-Clause"],
    BSD + "3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n": ["BSD-3-Clause"],
    "Text. Licensed under CC BY-NC 4.0.\nmore": ["CC-BY-NC-4.0"],
    "This work is licensed under the GNU General Public License, version 3. Next.": ["GPL-3.0"],
    "Released under the MIT Licence.\nOther words.": ["MIT"],
    "Foo.\nLicensed under the Apache License, Version 2.0.\nbar. This file is available under the MIT license.": ["Apache-2.0", "MIT"],
    "// SPDX-License-Identifier: GPL-2.0-only OR MIT\nint main;": ["GPL-2.0-only OR MIT"],
    "This program is free software; you can redistribute it.": [],
    "I renewed my driving licence. He gave permission. Apache helicopters fly.": [],
    "This is not released under the MIT license.": [],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_licences(text):
    assert licences(sequence(text)) == CASES[text]


def test_long_sentences_take_linear_time():
    began = time.perf_counter()
    sequence("copyright license redistributions in " * 50_000)
    assert time.perf_counter() - began < 10


def test_table(docs_of):
    rows = [(k, t, "en", "s") for k, t in enumerate(CASES)] + [(None, None, None, None), (0, MIT, "en", "s")]
    found = scan(docs_of(rows)).collect()
    assert len(found) == len(rows)
    texts = list(CASES.values())
    for r in found:
        assert r["licenses"] == ("" if r["doc_id"] is None else ",".join(texts[r["doc_id"]]))
        assert r["licensed"] == bool(r["licenses"])
    assert scan(docs_of([])).collect() == []


def forms(pattern):
    """All strings that a pattern of literals, groups, alternatives, ``?`` and small sets matches."""

    def each(items):
        return ["".join(x) for x in itertools.product(*(one(*i) for i in items))]

    def one(op, arg):
        match str(op):
            case "LITERAL":
                return [chr(arg)]
            case "AT":
                return [""]
            case "IN":
                return [chr(c) for kind, v in arg for c in (range(v[0], v[1] + 1) if str(kind) == "RANGE" else [v])]
            case "SUBPATTERN":
                return each(arg[3])
            case "BRANCH":
                return [x for b in arg[1] for x in each(b)]
            case "MAX_REPEAT":
                return ["", *each(arg[2])]
        raise ValueError(op)

    return each(re._parser.parse(pattern))


@pytest.mark.parametrize("key", SENTENCES)
def test_each_sentence_is_found_in_running_text(key):
    said = SENTENCES[key].replace("*", "some words").capitalize()
    assert sequence(f"Some text before it. {said}. Then other words.") == [None, key, None]


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_each_grant_is_found_in_running_text(blank):
    said = [(g + "Expat", "MIT") for g in forms(GRANT)] + [("Released under " + n, k) for k, p in NAMES.items() for n in forms(p)]
    for words, name in said:
        first, found, last = sequence(f"Some text before it. This is {re.sub(' +', blank, words)}. Then other words.")
        assert first is last is None and found and found.startswith(f"grant:{name}"), words


def test_headers_as_they_are_written():
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    assert sequence(mpl)[:2] == ["mpl2-subject", "mpl2-copy"] and licences(sequence(mpl)) == ["MPL-2.0"]
    for text, name in {"Distributed under the terms of the GPL v3.": "GPL-3.0", "This code is covered by the GPL 3.": "GPL-3.0", "Released under the 3-clause BSD.": "BSD-3-Clause", "Released under\nMIT.": "MIT"}.items():
        assert licences(sequence(text))[0].startswith(name), text


def test_more_names_and_bodies():
    for text, names in {
        "Licensed under the EUPL.": ["EUPL"],
        "Licensed under the EUPL, Version 1.2.": ["EUPL-1.2"],
        "Released under the Artistic License 2.0.": ["Artistic-2.0"],
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.": ["OFL-1.1"],
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. The GNU General Public License is a free, copyleft license for software and other kinds of works.": ["GPL-3.0"],
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at x.": ["EPL-2.0"],
    }.items():
        assert licences(sequence(text)) == names, text


def test_every_licence_of_the_names_has_rules_over_sentences():
    ruled = {name for name, rule in RULES if any(not want.startswith(("grant:", "spdx:")) for want in rule)}
    missing = {n for n in NAMES if not any(r == n or r.startswith(n) for r in ruled)}
    assert missing == {"Artistic", "CDDL", "MS-PL", "BUSL-1.1", "SSPL-1.0", "PSF-2.0"}  # known by name only


def brute_licences(ids):
    """The rules as regular expressions over the identifiers, tried at each place in their order."""
    text = "".join(f"<{x or '-'}>" for x in ids)
    neutral = "(?:" + "|".join(f"<{n}>" for n in NEUTRAL) + ")*"
    token = lambda w: "<" + (re.escape(w[:-1]) + "[^>]*" if w.endswith("*") else re.escape(w)) + ">"

    def patterns(rule):
        """All forms of a rule, those with more of its first optional parts before others."""
        forms = [[]]
        for want in rule:
            forms = [f + x for f in forms for x in ([[want.rstrip("?")], []] if want.endswith("?") else [[want]])]
        return [neutral.join(map(token, f)) for f in forms if f]

    table = [(name, [re.compile(p) for p in patterns(rule)]) for name, rule in RULES]
    out, at = [], 0
    while at < len(text):
        for name, forms in table:
            m = next((m for p in forms if (m := p.match(text, at))), None)
            if m:
                out.append(name or m[0].split(":", 1)[1].split(">")[0])
                at = m.end()
                break
        else:
            at = text.index(">", at) + 1
    return out


def test_against_brute_force(docs_of):
    """Texts put together from known sentences, grants, tags, copyright lines and others."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(3))
    say = lambda key: " ".join(word() if w == "*" else w for w in SENTENCES[key].split()).capitalize()
    keys = list(SENTENCES)
    rows, wanted = [], {}
    for k in range(150):
        ids, parts = [], []
        for _ in range(r.randint(0, 9)):
            x = r.random()
            if x < 0.45:
                at = r.randrange(len(keys))
                run = keys[at : at + r.choice((1, 1, 2, 4))]  # neighbours in the table are often neighbours in a rule
                ids += run
                parts += [say(i) for i in run]
            elif x < 0.6:
                name = r.choice(["MIT", "ISC", "Zlib", "Apache-2.0", "BSL-1.0"])
                ids.append(f"grant:{name}")
                parts.append({"MIT": "Released under the MIT license", "ISC": "Licensed under the ISC license", "Zlib": "Available under the zlib license", "Apache-2.0": "Licensed under the Apache License 2", "BSL-1.0": "Distributed under the Boost Software License 1"}[name])
            elif x < 0.7:
                ids.append("spdx:X-1")
                parts.append("SPDX-License-Identifier: X-1\n\n")
            elif x < 0.8:
                ids.append("copyright")
                parts.append(f"Copyright 2020 {word()}")
            else:
                ids.append(None)
                parts.append(f"{word()} {word()} {word()}")
        rows.append((k, "".join(p if p.endswith("\n") else p + ". " for p in parts), "en", "s"))
        wanted[k] = (",".join(i for i in ids if i), ",".join(dict.fromkeys(brute_licences(ids))))
    for row in scan(docs_of(rows)).collect():
        assert (row["sentence_ids"], row["licenses"]) == wanted[row["doc_id"]], rows[row["doc_id"]][1]
