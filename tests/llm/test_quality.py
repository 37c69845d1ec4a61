"""Counts and host verdicts against plain Python."""

import re
from collections import Counter

import pytest

from runassay.llm import quality

GOOD = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, source string, n_words string, host string, kept int"
ROWS = [
    (1, GOOD, "a", "x", "y", 0),
    (2, GOOD + "\n" + GOOD, "a", None, None, None),
    (3, None, "a", "x", "y", 0),
    (4, "", None, "x", "y", 0),
    (5, GOOD, None, "x", "y", 0),
    (None, GOOD + " #*$%&|<>", "b", "x", "y", 0),
    (7, "one two three " * 30, "b", "x", "y", 0),
    (8, "a b c\x1cd\te\x0bf\n \n\nsame line\nsame line\nsame line", "b", "x", "y", 0),
    (8, "a b c\x1cd\te\x0bf\n \n\nsame line\nsame line\nsame line", "b", "x", "y", 0),
    (9, "x " * 50_000, "c", "x", "y", 0),
]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
    }


def test_counts_and_verdicts(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["doc_id"], r["n_words"], r["host"]): r for r in quality.judge_quality(table).collect()}
    assert len(got) == len({(r[0], r[1], r[2]) for r in ROWS})
    for doc, text, source, *_ in ROWS:
        want = plain_counts(text)
        row = got[doc, want["n_words"], source]
        assert {k: row[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert row["base_failed"] == failed
        assert row["kept"] == (not failed and not row["host_rejected"])
    assert quality.judge_quality(table).count() == len(ROWS)
    assert quality.judge_quality(table.limit(0)).count() == 0
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    verdicts = {(r["doc_id"], r["n_words"]) for r in quality.judge_quality(table).where("kept").collect()}
    assert {(r["doc_id"], plain_counts(r["text"])["n_words"]) for r in kept.collect()} == verdicts


def test_counts_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = quality.counts_of([r["text"] for r in docs])
    for i, r in enumerate(docs):
        want = plain_counts(r["text"])
        assert {k: int(found[k][i]) for k in want} == want


def test_bad_host_falls_and_small_ones_are_shrunk(spark):
    junk = "junk " * 10
    rows = [(i, GOOD, f"good{i % 5}") for i in range(200)]
    rows += [(1000 + i, junk if i % 10 else GOOD, "spam") for i in range(200)]
    rows += [(2000, junk, "once"), (2001, GOOD, "once")]
    got = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    rejected = {r["host"] for r in got if r["host_rejected"]}
    assert rejected == {"spam"}
    assert all(not r["kept"] for r in got if r["host"] == "spam")
    assert all(r["kept"] for r in got if r["host"].startswith("good"))


@pytest.mark.parametrize("case", [(0, 0, 0, 0.0), (1, 10, 0, 0.0), (3, 100, 100, 100.0), (5, 1000, 300, 250.0)])
def test_prior_is_positive(case):
    alpha, beta = quality.beta_prior(*case)
    assert alpha > 0 and beta > 0
    if case[1]:
        assert abs(alpha / (alpha + beta) - case[2] / case[1]) <= 0.5 / (case[1] + 1) + 1e-9
