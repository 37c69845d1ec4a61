"""The stages one after another against their operators' rules in plain Python."""

import pytest

import corpus_pipeline
from runassay.llm import registry
from tests import oracle
from tests.llm.test_mixing import plain_draw, plain_sample_rates, plain_topic
from tests.llm.test_near_dups import plain_components
from tests.llm.test_packing import library_ids
from tests.llm.test_privacy import plain_base
from tests.llm.test_quality import plain_counts

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_plain_python(spark):
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    kept = []
    for row in rows:
        c = plain_counts(row[1])
        if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"]:
            kept.append(row)
    root = plain_components([r[:2] for r in kept], corpus_pipeline.NEAR_DUPLICATE_PERCENT)
    kept = [r for r in kept if root[r[0]] == r[0]]
    clean = []
    for doc, text, source, lang in kept:  # these texts hold no revealing terms and no overlaps
        for kind, a, b in sorted(plain_base(text), key=lambda s: -s[1]):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        clean.append((doc, text, source, lang))
    rates = plain_sample_rates(clean)
    drawn = {}
    for doc, text, source, lang in clean:
        if plain_draw(doc) < rates[source, lang, plain_topic(text)]:
            drawn[doc] = len(library_ids(text)) + 1
    got = corpus_pipeline.run(spark, FOLDER).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == drawn
    assert len({r["sequence_id"] for r in got}) <= sum(drawn.values()) // 2048 + 2


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_and_odd_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, words, None, None, 5), (1, words, None, None, 5)], schema)
    f = corpus_pipeline.STAGES[stage][1]
    assert f(spark, odd.limit(0), FOLDER).count() == 0
    out = f(spark, odd, FOLDER)
    assert out.where("doc_id = 1").count() >= 1
    if stage < 4:
        assert out.columns == odd.columns


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_queries_run_and_match_their_sql(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert oracle.differences(df, oracle.connect(FOLDER), sql) is None
    else:
        assert df.count() > 0
