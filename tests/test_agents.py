import difflib
import random

import pytest
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions import similarity
from runassay.functions.language import language_headings, named_language
from runassay.operators import agents, matching


@pytest.fixture
def catalog(spark):
    rows = [
        ("Chat Helper", ["聊天機器人"], 0), ("Market Analysis", ["市場分析報告"], 1),
        ("Cover Letter", ["求職信"], 2), ("Plan", ["計劃", "方案"], 3),
        ("Cover Letter", ["求職信二"], 4), ("Other", ["計劃"], 5),
    ]
    return spark.createDataFrame(rows, "en string, tc array<string>, pos long")


def test_catalog_sets(catalog):
    names = {r.name for r in agents.valid_names(catalog).collect()}
    assert names == {"Chat Helper", "聊天機器人", "Market Analysis", "市場分析報告", "Cover Letter", "求職信二", "Plan", "計劃", "方案", "Other"}
    assert {r.name: r.en for r in agents.english_names(catalog).collect()}["計劃"] == "Other"
    assert [(r.en, r.entries, r.lost_names) for r in agents.duplicate_entries(catalog).collect()] == [("Cover Letter", 2, 1)]


def test_catalog_file(spark, tmp_path):
    (tmp_path / "catalog.json").write_text('{"en": "A", "tc": ["甲"], "pos": 1}\n', encoding="utf-8")
    assert [tuple(r) for r in agents.read_catalog(spark, str(tmp_path)).collect()] == [("A", ["甲"], 1)]


def test_resolution(spark, catalog):
    raw = ["Chat Helper", " chat helper ", "Chat Helpr", "聊天機器人", "zzzzzzzzzz", "", None, "market analysys"]
    tasks = spark.createDataFrame([(i, a, "zh-TW" if i % 2 else "match") for i, a in enumerate(raw)], "k int, agent string, language string")
    got = {r.k: (r.final_agent, r.how, r.state, r.candidates) for r in agents.resolve_agents(tasks, catalog, ["k"]).collect()}
    assert got[0] == ("Chat Helper", "exact", "4", ["聊天機器人"])  # "match" holds "tc"
    assert got[1][:3] == ("Chat Helper", "case", "4")
    assert got[2][:3] == ("Chat Helper", "fuzzy", "4")
    assert got[3] == ("聊天機器人", "exact", "4", ["聊天機器人"])
    assert got[4] == ("", "none", "2", []) and got[5] == ("", "blank", "2", []) and got[6] == ("", "blank", "2", [])
    assert got[7][:2] == ("Market Analysis", "fuzzy")
    english = tasks.withColumn("language", F.lit("English"))
    got = {r.k: r.candidates for r in agents.resolve_agents(english, catalog, ["k"]).collect()}
    assert got[3] == ["Chat Helper"] and got[0] == ["Chat Helper"]


def test_fuzzy_equals_difflib(spark):
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(3, 12))).strip() for _ in range(60)} - {""})
    words = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(120)})
    folded = spark.createDataFrame([(n, n) for n in names], "folded string, name string")
    found = agents.fuzzy_names(spark.createDataFrame([(w,) for w in words], "word string"), folded)
    want = {}
    for w in words:
        hit = difflib.get_close_matches(w, names, n=1, cutoff=0.6)
        if hit:
            want[w] = hit[0]
    assert len(want) > 20 and {r.word: r.folded for r in found.collect()} == want


@pytest.mark.parametrize("cutoff,letters", [(0.6, "abcé "), (0.6, "abcdefghijklmnop"), (0.85, "abcdef"), (0.3, "abcdefghijk")])
def test_no_near_pair_is_lost(spark, cutoff, letters):
    rng = random.Random(len(letters))

    def text():
        return "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 26))))

    words, names = sorted({text() for _ in range(90)}), sorted({text() for _ in range(110)} | {"x" * 90, "y" * 300})
    w, n = (spark.createDataFrame([(x,) for x in t], f"{c} string") for t, c in ((words, "word"), (names, "name")))
    met = {tuple(r) for r in similarity.candidates(w, n, cutoff).collect()}
    near = {(a, b): difflib.SequenceMatcher(a=b, b=a).ratio() for a in words for b in names}
    assert {p for p, r in near.items() if r >= cutoff} <= met
    got = {r.word: (r.ratio, r.name) for r in similarity.nearest(w, n, cutoff).collect()}
    best = {a: max((near[a, b], b) for b in names) for a in words}
    assert got == {a: x for a, x in best.items() if x[0] >= cutoff}
    empty = w.limit(0)
    assert similarity.nearest(empty, n, cutoff).count() == similarity.nearest(w, n.limit(0), cutoff).count() == 0


def test_fewer_pairs_meet_than_lengths_allow(spark):
    rng = random.Random(2)
    parts = ["ma", "ker", "pro", "fin", "data", "plan", "er", "lo", "gis", "tic", "sales", "desk", "re", "qu", "iz", "vy", "hr", "ops"]
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(1200)})
    words = rng.sample(names, 150)
    w, n = (spark.createDataFrame([(x,) for x in t], f"{c} string") for t, c in ((words, "word"), (names, "name")))
    fitting = sum(len(b) <= len(a) * 7 / 3 and len(a) <= len(b) * 7 / 3 for a in words for b in names)
    assert similarity.candidates(w, n, 0.6).count() * 2.5 < fitting


def test_language_query_equals_difflib(spark):
    """Every distinct cell of the language query, headings and part names, against the library."""
    from runassay.plans import queries

    for r in queries.f9_language_col(spark, "/root/testdata/sf0.001").collect():
        plain = r.word in S.LANGUAGE_HEADINGS or any(p in r.word for p in S.LANGUAGE_HEADING_PARTS)
        assert r.is_language is (plain or bool(difflib.get_close_matches(r.word, S.LANGUAGE_HEADINGS, n=1, cutoff=0.6))), r.word


def test_fuzzy_over_part_names(spark):
    """Long names of several words, misspelt in several ways."""
    parts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()]
    rng = random.Random(9)
    words = set()
    for name in rng.sample(sorted(parts), 40):
        cut = list(name)
        for _ in range(rng.randint(1, 9)):
            cut.pop(rng.randrange(len(cut)))
        words.add("".join(cut))
    folded = spark.createDataFrame([(n,) for n in parts], "folded string")
    found = agents.fuzzy_names(spark.createDataFrame([(w,) for w in words], "word string"), folded)
    want = {}
    for w in words:
        hit = difflib.get_close_matches(w, parts, n=1, cutoff=0.6)
        if hit:
            want[w] = hit[0]
    assert {r.word: r.folded for r in found.collect()} == want and want


def test_long_titles_are_cheap(spark):
    tasks = spark.createDataFrame([(1, "a", "X", ["needle"])], "k int, env string, final_agent string, candidates array<string>")
    offered = spark.createDataFrame([("a", "x" * 3000 + "Needle" + "y" * 3000)], "env string, title string")
    assert agents.first_offered(tasks, offered, ["k"]).first().picked == "needle"


def test_language_heading_test(spark):
    words = ["change", "lane", "Language", "UI Lang ", "ui语言", "語言x", "price", "x" * 40, "notes", "selectd languge"]
    got = {r.word: r.is_language for r in language_headings(spark.createDataFrame([(w,) for w in words], "value string")).collect()}
    for w in words:
        w = w.strip().lower()
        want = w in S.LANGUAGE_HEADINGS or any(p in w for p in S.LANGUAGE_HEADING_PARTS) or bool(
            difflib.get_close_matches(w, S.LANGUAGE_HEADINGS, n=1, cutoff=0.6))
        assert got[w] is want, w


def test_first_offered(spark):
    tasks = spark.createDataFrame(
        [(1, "a", "X", ["Nope", " Chat "]), (2, "b", "X", ["Chat"]), (3, "a", "", [])],
        "k int, env string, final_agent string, candidates array<string>")
    offered = spark.createDataFrame([("a", " Add CHATBOT "), ("b", "Other"), ("b", None)], "env string, title string")
    got = {r.k: (r.picked, r.agent_used, r.state) for r in agents.first_offered(tasks, offered, ["k"]).collect()}
    assert got == {1: (" Chat ", "X", "4"), 2: (None, "X" + S.AGENT_NOT_OFFERED, "2"), 3: (None, "", "2")}


def test_file_matching(spark):
    corpus = spark.createDataFrame([("A.TXT",), ("a.pdf",), ("b.v1.csv",), ("b.v1.docx",)], "file_name string")
    names = [" a.txt ", "A.docx", "b.v1.txt", "c.txt", "", None, "a"]
    tasks = spark.createDataFrame([(i, n, "ask" if i % 2 else "") for i, n in enumerate(names)], "k int, filename string, request string")
    matched = matching.skip_reason(matching.match_files(tasks, corpus, ["k"]))
    got = {r.k: (r.matched_file, r.match_kind, r.skip_reason, r.input_mode) for r in matched.collect()}
    assert got == {
        0: ("A.TXT", "exact", None, "file"), 1: ("A.TXT", "base", None, "file"), 2: ("b.v1.csv", "base", None, "file"),
        3: (None, "none", None, "text_degraded"), 4: (None, "blank", S.SKIP_EMPTY, "skipped"),
        5: (None, "blank", None, "text"), 6: ("A.TXT", "base", None, "file"),
    }


def test_named_language(spark):
    texts = ["这是说明", "這是說明會對", "hello", "这是说明 and a lot of English", "", "这國来時", "中文"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(named_language("v")).collect()]
    assert got == ["简体中文", "繁体中文", "English", "English", "N/A", "繁体中文+简体中文", "简体中文"]
