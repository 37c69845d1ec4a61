"""Automata and phrase counts against brute force; held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from runassay.llm import language


def substrings(text):
    return {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}


@pytest.mark.parametrize("seed", range(5))
def test_automaton_reads_exactly_the_substrings(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abc") for _ in range(30))
    moves = language.suffix_automaton([ord(c) for c in text])
    known = substrings(text)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        at = 0
        for c in word:
            at = moves[at].get(ord(c)) if at is not None else None
        assert (at is not None) == (word in known)


def folded(text):
    out = ""
    for c in text:
        if c.isalpha():
            out += c.lower()
        elif out and not out.endswith(" "):
            out += " "
    return out


def plain_phrases(sample, text):
    """Greedy longest matches over the whole text; an unseen letter is in no phrase's middle."""
    count, phrase = 0, ""
    for c in text:
        if phrase + c in sample:
            phrase += c
        else:
            count += 1
            phrase = c if c in sample else ""
    return count + bool(text)


@pytest.mark.parametrize("cells", [None, 0])
@pytest.mark.parametrize("block", [1, 2, 7, 1024])
def test_phrases_equal_brute_force(monkeypatch, block, cells):
    """As a table and as a sorted list, with blocks that cut every phrase."""
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(block)
    samples = {"aa": ["the cat sat on the mat", "a dog and a log" * 40], "bb": ["der hund und die katze", "ein baum"], "cc": ["ab" * 300]}
    model = language.LanguageModel.of(samples, cells)
    own = {k: folded("".join(t + " " for t in v)) for k, v in samples.items()}
    texts = ["The cat, und der Hund!", "", "xyz zyx", "1234", "a" * 3000, "Ünd die katze -- the mat " * 99, "ab" * 1500, "ba" * 2100 + "x" + "ab" * 900]
    texts += ["".join(rng.choice(["ab", "ba", "the ", "log", "a dog ", "z"]) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    total, sizes = model.phrases(texts)
    for i, text in enumerate(texts):
        plain = folded(text)
        assert sizes[i] == len(plain)
        # Letters outside all samples are one symbol that no sample holds.
        plain = "".join(c if c == " " or any(c in s for s in own.values()) else "\x00" for c in plain)
        assert total[i].tolist() == [plain_phrases(own[k], plain) for k in sorted(own)], text[:40]


def test_large_alphabets_stay_small():
    rng = random.Random(2)
    text = "".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(12_000))
    model = language.LanguageModel.of({"zz": [text], "en": ["the cat sat on the mat"]})
    assert model.automata[1].table is None and len(model.automata[1].keys) < 80_000
    assert model.predict([text[500:560], "the mat"])[0] == ["zz", "en"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in truth if got[d]["held_out"]]
    assert len(held) > 200
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en", 1.0) for i in range(0, 40)]
    rows += [(100 + i, "der schnelle braune fuchs springt weit", "de", 1.0) for i in range(40)]
    odd = [(500, None, "en", None), (501, "", "de", None), (502, "123 !!", "de", None), (503, "the lazy dog", None, None)]
    odd += [(None, "der braune fuchs", "de", None)] * 2 + [(504, "the dog " * 20_000, "en", None)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    got = language.identify(table).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[k] for k in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "en", "en", "de"]
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert language.identify(table.limit(0)).count() == 0
    bare = table.where("doc_id >= 500").withColumn("lang", table.lang.substr(99, 1)).where("lang = 'none'")
    assert bare.count() == 0


def worded(rng, letters, n):
    """Texts of invented words over some letters."""
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(80)) for _ in range(n)]


def test_a_tiny_language_costs_the_others_nothing(spark):
    rng = random.Random(5)
    texts = {"aa": worded(rng, "abcdefgh", 200), "bb": worded(rng, "abcdefgh", 200)}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    rows += [(1000, "habe cafe dabei fade", "cc"), (1001, "a", "dd")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(table.where("doc_id >= 50"), F.lit(True))
    assert model.languages == ["aa", "bb", "cc", "dd"]
    for lang, ts in texts.items():
        assert model.predict([t[:200] for t in ts[:50]])[0] == [lang] * 50


def test_a_language_of_few_texts_is_learnt_whole(spark):
    rng = random.Random(6)
    few, many = worded(rng, "abcdefgh", 10), worded(rng, "abcdefgh", 300)
    rows = [(i, few[i % 10], "aa") for i in range(3000)] + [(i, t, "bb") for i, t in enumerate(many)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.predict(few + many[:20])[0] == ["aa"] * 10 + ["bb"] * 20


def test_excerpts_reach_the_end(spark):
    table = spark.createDataFrame([("a" * 5000 + "b" * 4000 + "the end",), ("short",)], "text string")
    got = [r[0] for r in table.select(language.excerpts(F.col("text"), F.lit(100))).collect()]
    assert len(got[0]) == 403 and got[0].startswith("a" * 100) and got[0].endswith("the end") and got[1] == "short"


def test_languages_of_the_most_texts_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, f"wort {i} der", "de") for i in range(9)] + [(20 + i, f"word {i} the", "en") for i in range(8)] + [(50, "mot", "fr")]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["de", "en"]
