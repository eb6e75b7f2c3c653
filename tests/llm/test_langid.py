import math
import random
import re
import zlib
from collections import Counter

from marlstone.llm.langid import fit, held_out, identify
from marlstone.llm.queries import op10_language_id


def run(docs, **options):
    return identify(docs, fit(docs, **options), keep={"doc_id": docs["doc_id"], "held_out": held_out(docs["doc_id"], 3)})


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op10_language_id(spark, sf).collect()
    assert len(found) == len(lang)
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98


def test_edges(docs_of):
    rows = [(k, "the cat and the dog" if k % 2 else "der Hund und die Katze", "en" if k % 2 else "de", "s") for k in range(40)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "12 !? 3", "en", "s"), (103, "the dog", None, "s"), (None, "die Katze", None, None), (104, "Und die " * 20_000, None, "s")]
    found = {r["doc_id"]: r for r in run(docs_of(rows)).collect()}
    assert [found[k]["lang_pred"] for k in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "en", "de", "de"]
    assert found[100]["score"] == 0 and 0.5 < found[103]["score"] <= 1


def test_one_text_or_many_make_no_difference(docs_of):
    rows = [(k, ["the cat and dog", "der Hund und Katze", "le chat et le chien"][k % 3] + f" {k}", ["en", "de", "fr"][k % 3], "s") for k in range(90)]
    docs = docs_of(rows)
    model = fit(docs)
    key = {"doc_id": docs["doc_id"]}
    some = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in identify(docs, model, keep=key).collect()}
    for r in identify(docs.where("doc_id < 3"), model, keep=key).collect():
        assert some[r["doc_id"]] == (r["lang_pred"], round(r["score"], 9))


def test_nothing_to_learn_from(docs_of):
    assert run(docs_of([])).collect() == []
    assert {r["lang_pred"] for r in run(docs_of([(1, "text", None, "s")])).collect()} == {"und"}


def test_against_brute_force(docs_of):
    """Naive Bayes by the book over the same buckets: counts with 0.5 added, log-probabilities added up gram by gram."""
    r = random.Random(3)
    letters = {"en": "etaoinshrdlu", "de": "enisratdhulcäöüß", "fr": "esaitnrulodcéèà", "ru": "оеаинтсрвлкмд"}
    text = lambda lang: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(1, 8))) for _ in range(r.randint(0, 12)))
    rows = [(k, text(lang := r.choice(list(letters))) + r.choice(["", " 12", "!", " ЖÉ"]), lang if r.random() < 0.9 else None, "s") for k in range(300)]
    docs = docs_of(rows)
    buckets = 1 << 16  # of four languages

    def grams(t):
        folded = "".join(c.lower()[0] if c.isalpha() else " " for c in t)
        s = " " + re.sub(" +", " ", folded) + "  "
        for at in range(len(s) - 2):
            h = 0
            for n, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                h = (h ^ ord(s[at + n])) * factor % 2**32
                yield (h ^ h >> 15) * 0x27D4EB2F % 2**32 >> 16

    train = [(t, lang) for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    langs = sorted({lang for _, lang in train})
    counts = {lang: Counter() for lang in langs}
    for t, lang in train:
        counts[lang].update(grams(t))
    size = {lang: sum(counts[lang].values()) + 0.5 * buckets for lang in langs}
    prior = Counter(lang for _, lang in train)
    found = {x["doc_id"]: x for x in run(docs).collect()}
    for i, t, _, _ in rows:
        if not any(c.isalpha() for c in t):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        logs = {lang: math.log(prior[lang] / len(train)) + sum(math.log((counts[lang][g] + 0.5) / size[lang]) for g in grams(t)) for lang in langs}
        top = max(logs.values())
        wanted = 1 / sum(math.exp(v - top) for v in logs.values())
        assert abs(found[i]["score"] - wanted) < 1e-6, (i, t)
        assert logs[found[i]["lang_pred"]] > top - 1e-6


def test_the_sample_is_bounded_where_ids_are_alike(docs_of):
    rows = [(None if k % 2 else 7, f"the cat w{k} and dog" if k % 3 else f"der Hund w{k} und Katze", "en" if k % 3 else "de", "s") for k in range(600)]
    for limit in (60, 16_000):
        langs, _ = fit(docs_of(rows), fit_docs=limit)
        assert langs == ["de", "en"]


def test_a_very_long_text(docs_of):
    rows = [(k, "the cat and the dog" if k % 2 else "der Hund und die Katze", "en" if k % 2 else "de", "s") for k in range(60)] + [(100, "the dog and cat " * 150_000, None, "s")]
    assert {r["doc_id"]: r["lang_pred"] for r in run(docs_of(rows)).collect()}[100] == "en"
