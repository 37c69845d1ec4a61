import os

import pytest
from pyspark.sql import functions as F

from runassay.functions import text as T


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_percent_is_the_text_of_python(spark):
    pairs = [(c, t) for t in (0, 1, 3, 7, 32, 96, 160, 800, 4000, 20000, 99991) for c in range(0, t + 1, max(1, t // 150))]
    pairs += [(-1, 3), (-5, 32), (-1, 100000), (203, 20000), (1, 4000), (3, 4000)]
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(pairs)], "i int, c long, t long")
    got = [r[0] for r in df.orderBy("i").select(T.percent("c", "t")).collect()]
    assert got == [f"{c / t:.2%}" if t else "0.00%" for c, t in pairs]


def test_mean_text(spark):
    values = [0.0, 0.05, 0.15, 0.25, 12.35, 99.95, 1234.449999, 56.6093835616438]
    assert column(spark, values, T.fixed_point(F.col("v"), 1), "double") == [f"{v:.1f}" for v in values]


def test_seconds(spark):
    values = ["12.5s", " 7 s", "N/A", None, "NaNs", "1e2s", "12.5d", "0x10", "3s4s", "", "s", ".5s", "infs"]
    assert column(spark, values, T.seconds("v")) == [
        12.5, 7.0, None, None, None, 100.0, None, None, 34.0, None, None, 0.5, float("inf"),
    ]


@pytest.mark.parametrize("name", ["a.txt", "a.b.pdf", ".bashrc", "..x", "plain", "a.", "a.tar.gz", ".a.b"])
def test_base_name(spark, name):
    base, ext = os.path.splitext(name)
    assert column(spark, [name], T.base_name("v")) == [base]
    assert column(spark, [name], T.extension("v")) == [ext]


def test_strip_takes_what_python_takes(spark):
    values = ["  a b \n", "　x ", "\x1cq\x85", "", " \t", "中 "]
    assert column(spark, values, T.stripped("v")) == [v.strip() for v in values]


def test_json_body(spark):
    values = ['x {"a": 1} y', '{"a": 1}}', '{"a":1} {"b":2}', "none", '{"a": {"b": 1}}', '```{\n"a":2}\n```', "{bad}", None]
    assert column(spark, values, T.json_body("v")) == [
        '{"a": 1}', None, None, None, '{"a": {"b": 1}}', '{\n"a":2}', None, None,
    ]


def test_block_is_lazy_and_trimmed(spark):
    values = ["---BLOCK1_START---\n a\nb \n---BLOCK1_END--- ---BLOCK1_END---", "---BLOCK1_START--- a", None]
    assert column(spark, values, T.block("v", 1)) == ["a\nb", None, None]


def test_id_cells_and_numbers(spark):
    values = ['1, 2 "3"', "12", "a1", "", None]
    assert column(spark, values, T.is_id_cell("v")) == [True, True, False, False, False]
    assert column(spark, ["1, 22 x3"], T.numbers("v")) == [[1, 22, 3]]


def test_clean_keeps_tab_and_newlines(spark):
    assert column(spark, ["a\x00\x08\t\n\r\x0b\x0c\x0e\x1fb"], T.clean_text("v")) == ["a\t\n\rb"]


def test_page_times(spark):
    html = '<number-flow-react class="x" value="3.5"></number-flow-react><NUMBER-FLOW aria-valuenow=12>'
    prep, done = T.page_times("v")
    assert column(spark, [html, "<p>"], F.concat_ws(",", prep, done)) == ["3.5s,12s", "N/A,N/A"]


def test_marks(spark):
    values = ["see [12]", "[a]", "at https://x.org", "References: none", "資料來源", None]
    assert column(spark, values, T.has_citation("v")) == [True, False, False, False, False, False]
    assert column(spark, values, T.has_reference("v")) == [False, False, True, True, True, False]


def test_ends_of_long_texts(spark):
    """The same as trimming and translating every text, without reading and rebuilding it by characters."""
    texts = [None, "", " ", "a", "\u3000a b\n", "a\x1f", "x\ny\n", *[f"{w}a{w}b{w}" for w in T.WHITE_SPACE]]
    assert column(spark, texts, T.stripped_text("v")) == [t and t.strip(T.WHITE_SPACE) for t in texts]
    assert column(spark, texts, T.excerpt("v", chars=None)) == [t and t.replace("\n", " ") for t in texts]
    lines = spark.createDataFrame([(1, "e", " a\nb ")], "label int, evaluation string, answer string").select(T.evaluation_line(chars=None))
    assert lines.first()[0] == "[Test ID: 1] Eval: e | Ans: a b"
    assert "translate" not in lines._jdf.queryExecution().analyzed().toString()
