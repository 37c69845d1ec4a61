"""Folding, automaton against plain search, and held-out accuracy."""

import random

from runassay.llm import toxicity
from runassay.llm.toxicity import Lexicon, ToxicityModel, fold


def test_fold():
    assert fold("An IDI0T, 1diot; ѕtuріd déjà") == " an idiot idiot stupid deja "
    assert fold("$cum !diot loser!!! word$$$ 2024") == " scum idiot loser word "
    assert fold("") == "  "


def plain_hits(lexicon, text):
    best = {}
    for pattern, weight in lexicon.weights:
        for i in range(len(text)):
            if text.startswith(pattern, i):
                best[i] = max(best.get(i, 0), weight)
    cuts = [(i, i + len(e) - 1) for e in lexicon.exceptions for i in range(len(text)) if text.startswith(e, i)]
    return {i: w for i, w in best.items() if not any(a <= i < b for a, b in cuts)}


def test_hits_equal_plain_search():
    lexicon = Lexicon(((" trash ", 3.0), (" tras", 1.0), (" idiot", 2.0), (" ab", 4.0)), (" trash can ", " not idiot "))
    rng = random.Random(3)
    for _ in range(300):
        text = fold(" ".join(rng.choice(["trash", "can", "idiots", "not", "idiot", "ab", "tras", "x"]) for _ in range(12)))
        assert lexicon.hits(text) == plain_hits(lexicon, text)
    assert Lexicon(()).hits(" a ") == {}


def test_length_lowers_the_score():
    model = ToxicityModel(Lexicon(((" idiot ", 5.0),)), -4.0, 2.0, 0.1)
    assert model.score("idiot")[0] > model.score("idiot " + "word " * 200)[0] > model.score("word")[0]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    rows = [r for r in toxicity.score_toxicity(docs, model).collect() if r["doc_id"] in truth]
    hits = sum(r["predicted"] == truth[r["doc_id"]] for r in rows)
    assert len(rows) > 300 and hits >= 0.97 * len(rows)
    found = sum(r["predicted"] == 1 for r in rows if truth[r["doc_id"]] == 1)
    assert found >= 0.8 * sum(truth[r["doc_id"]] for r in rows)


def test_odd_rows(spark):
    words = ["one", *(a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnr")]
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        text = rng.sample(words, 8)
        if i % 4 == 0:
            text.insert(rng.randint(0, 8), "awful")
        rows.append((i, " ".join(text), "x", 1))
        labels.append((i, int(i % 4 == 0)))
    odd = [(900, None, None, None), (901, "", "x", 1), (902, "awф 4wful " + "one " * 90_000, "x", 1), (None, "one awful", "x", 1)]
    table = spark.createDataFrame(rows + odd + odd[-1:], "doc_id long, text string, toxic string, score int")
    known = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(table, known, exceptions=["Awful nice"])
    assert any(p == " awful " for p, _ in model.lexicon.weights) and " awful nice " in model.lexicon.exceptions
    got = toxicity.score_toxicity(table, model).collect()
    assert len(got) == len(rows) + 5
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == t for i, t in labels)
    assert by[900]["score"] == by[901]["score"] < 0.5 and by[902]["n_hits"] == 1
    assert toxicity.score_toxicity(table.limit(0), model).count() == 0
    none = toxicity.fit_toxicity(table, known.limit(0))
    assert {r["predicted"] for r in toxicity.score_toxicity(table, none).collect()} <= {0, 1}
