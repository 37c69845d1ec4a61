import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.operators import insight, judge, outcomes
from runassay.plans import evaluate

DAY = datetime.date(2024, 1, 1)


def asked(spark, n=4):
    rows = [(i, f"q{i}", "doc", f"a{i}", "", "No") for i in range(n)]
    return spark.createDataFrame(rows, "id int, request string, document string, answer string, target_language string, timeout_states string")


def flaky():
    calls = {}

    def reply(row):
        calls[row["request"]] = calls.get(row["request"], 0) + 1
        if row["request"] == "q0":
            raise RuntimeError("down")
        if row["request"] == "q1" and calls["q1"] < 3:
            return "not json"
        return 'ok {"tester_expectation": "Good"} end'

    return reply


def test_retry_then_verdict(spark):
    waits = spark.sparkContext.accumulator(0)

    def wait(seconds, waits=waits):
        waits.add(1)
        assert 2.5 <= seconds <= 6.0

    replies = judge.ask(asked(spark), flaky, ["id"], partitions=2, wait=wait)
    got = {r.id: r for r in judge.parse_verdict(replies).collect()}
    assert [got[i].attempts for i in range(4)] == [3, 3, 1, 1]
    assert waits.value == 4
    assert got[0].tester_expectation == S.PARSE_ERROR_RATING and "down" in got[0].evaluation
    assert got[0].language_status == "Failed" and got[0].input_language == "Parse Error"
    assert got[1].tester_expectation == "Good" and got[1].reference_link == "N/A" and got[1].evaluation == "Unknown"


def test_timeouts_are_never_sent(spark):
    rows = asked(spark).withColumn("timeout_states", F.when(F.col("id") < 3, S.TOTAL_TIMEOUT).otherwise("No"))
    assert [r.id for r in judge.judge(rows, ["id"]).collect()] == [3]


def test_documents_go_whole_unless_bounded(spark):
    rows = asked(spark, 1).withColumn("document", F.expr("repeat('x', 60000)"))

    def size():
        return lambda row: '{"evaluation": "%d"}' % len(row["document"])

    assert judge.judge(rows, ["id"], size).first().evaluation == "60000"
    assert judge.judge(rows, ["id"], size, document_chars=50_000).first().evaluation == "50000"


def test_last_reply_is_kept(spark):
    def backend():
        tries = []

        def reply(row):
            tries.append(1)
            if len(tries) == 3:
                raise RuntimeError("down")
            return f"busy {len(tries)}"

        return reply

    got = judge.ask(asked(spark, 1), backend, ["id"], wait=lambda s: None).first()
    assert (got.reply, got.attempts, got.error) == ("busy 2", 3, "down")


def test_audit(spark):
    rows = [("Great", "en", "en", "Pass"), ("Good", "en", "fr", "Failed"), ("Poor", "en", "fr", "Pass")]
    df = spark.createDataFrame(rows, "tester_expectation string, input_language string, output_language string, language_status string")
    got = judge.audit_verdicts(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert (got.verdicts, got.odd_ratings, got.rated_above_cap, got.unequal_passes) == (3, 1, 1, 1)


def test_outcomes(spark):
    df = spark.createDataFrame(
        [(S.EMPTY_ANSWER, "No"), (S.EMPTY_ANSWER, S.TOTAL_TIMEOUT), ("text", "No")], "answer string, timeout_states string")
    got = [(r.timeout_states, r.needs_judge, r.evaluation) for r in outcomes.after_capture(df).collect()]
    assert got == [
        (S.GENERATION_TIMEOUT, False, S.TIMEOUT_EVALUATION),
        (f"{S.TOTAL_TIMEOUT} & {S.GENERATION_TIMEOUT}", False, S.TIMEOUT_EVALUATION), ("No", True, None),
    ]
    errors = spark.createDataFrame([("No Such Window x", "未指定", "A"), ("e" * 200, "未指定", ""), ("e", "B", "A")],
                                   "error string, agent_used string, agent string")
    got = [(r.crash, r.agent_used, r.timeout_states) for r in outcomes.after_error(errors).collect()]
    assert got == [(S.CRASH_PREFIX + "e" * 150, "未指定", S.CRASH_TIMEOUT_STATE), (S.CRASH_PREFIX + "e", "B", S.CRASH_TIMEOUT_STATE)]


def test_evaluation_with_a_judge(spark):
    tasks = spark.createDataFrame(
        [(0, "ask", "A.txt", "chat", "tc"), (1, "ask", "none.pdf", "", ""), (2, "", "", "", ""), (3, "ask", "", "x", ""),
         (4, "ask", "", "", ""), (5, "ask", "", "", "")],
        "idx long, request string, filename string, agent string, language string")
    captures = spark.createDataFrame(
        [(0, "fine", "No", "u0", "1s", "2s", None, False), (1, S.EMPTY_ANSWER, "No", "u1", "1s", "2s", None, False),
         (3, None, "No", "u3", "1s", "2s", "boom, bang", False), (4, "", "No", "u", "1s", "2s", "No Such Window", False),
         (5, "half", "No", "u", "1s", "2s", None, True)],
        "idx long, answer string, timeout_states string, shared_link string, prep_time string, completion_time string, "
        "error string, stopped boolean")
    corpus = spark.createDataFrame([("a.TXT", "the document")], "file_name string, text string")
    catalog = spark.createDataFrame([("Chat", ["聊天"], 0)], "en string, tc array<string>, pos long")

    def backend():
        return lambda row: '{"tester_expectation": "Excellent", "evaluation": "%s"}' % row["document"]

    prepared = evaluate.prepare(tasks, corpus, catalog, ["idx"])
    got = {r.idx: r for r in evaluate.evaluate(prepared, captures, corpus, ["idx"], backend).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert set(S.RESULT_HEADINGS.values()) <= set(got[0].asDict())
    pick = lambda r: (r.label, r.crash, r.tester_expectation, r.evaluation, r.agent_used, r.timeout_states, r.shared_link)
    assert pick(got[0]) == (1, "No", "Excellent", "the document", "Chat", "No", "u0")
    assert pick(got[1]) == (2, "No", "Failed", S.TIMEOUT_EVALUATION, "未指定", S.GENERATION_TIMEOUT, "u1")
    assert pick(got[2]) == (3, S.SKIP_EMPTY, "Failed", "Unknown", "未指定", "No", "N/A")
    crash = S.CRASH_PREFIX + "boom, bang"
    assert pick(got[3]) == (4, crash, "Failed", crash, "x", S.CRASH_TIMEOUT_STATE, "u3")
    assert (got[2].answer, got[3].answer, got[0].selected_language) == (S.SKIP_ANSWER, S.CRASH_ANSWER, "tc")


BLOCK = """Failure Reason Breakdown,,,
"One test, many issues",,,
Failure / Issue Type,Matching Test IDs,Example
"Formatting (e.g., tables)",10,2," 7",2,"bad, table"
Wrong language,"3, 4",example
No ids,none,example
,,,
After blank,5,x"""


def test_block_rows(spark):
    df = spark.createDataFrame([(DAY, "a", BLOCK)], "run_date date, env string, text string")
    rows = insight.block_rows(df).orderBy("row_no").collect()
    got = [(r.kind, r["first"], r.ids, r.texts) for r in rows]
    assert got[2:] == [
        ("heading", "Failure / Issue Type", None, ["Matching Test IDs", "Example"]),
        ("ids", "Formatting (e.g., tables)", [2, 7, 10], ["bad, table"]),
        ("ids", "Wrong language", [3, 4], ["example"]),
        ("text", "No ids", None, ["none", "example"]),
        ("text", "After blank", None, ["5", "x"]),
    ]


def test_replies_in_parts_cover_every_line(spark):
    lines = spark.range(1, 1002).select(F.lit(DAY).alias("run_date"), F.lit("a").alias("env"),
                                        F.col("id").alias("label"), F.concat(F.lit("line "), "id").alias("text"))

    def backend():
        def reply(topic, part):
            if "line 1" in part:
                raise RuntimeError("down")
            ids = ",".join(x.split()[1] for x in part)
            return f"---BLOCK1_START---\nIssue,Matching Test IDs,Example\nAll,\"{ids}\",x\n---BLOCK1_END---"
        return reply

    replies = insight.ask_for_blocks(lines, backend, lines_per_call=100, wait=lambda s: None).collect()
    assert len(replies) == 11 and sum(r.reply is None for r in replies) == 1
    blocks = insight.blocks_of(spark.createDataFrame(replies))
    ids = insight.cluster_ids(insight.block_rows(blocks))
    assert sorted(r.id for r in ids.collect()) == list(range(100, 1002))
    texts = {(r.block, r.text.splitlines()[-1]) for r in blocks.where("part = 0").collect()}
    assert texts == {(1, "Error,API Failed,,"), (2, "Error,API Failed,,"), (3, "Error,API Failed,,")}
    later = {r.block: r.text for r in blocks.where("part = 1").collect()}
    assert "Parsing Failed" in later[3] and later[1].startswith("Issue")


def test_lines_are_moved_once_and_read_in_order(spark):
    """No lists of lines are built before the call; null labels and texts are told as before."""
    rows = [(DAY, "a", 7, "b"), (DAY, "a", 3, "z"), (DAY, "a", 3, None), (DAY, "a", None, None), (None, None, 12, "c"), (DAY, "a", 11, "d")]
    lines = spark.createDataFrame(rows, "run_date date, env string, label long, text string")

    def backend():
        return lambda topic, part: f"{topic}: {part}"

    asked = insight.ask_for_blocks(lines, backend, "topic", lines_per_call=10)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "collect_list" not in plan
    got = {(r.run_date, r.env, r.part): r.reply for r in asked.collect()}
    assert got == {
        (DAY, "a", None): "topic: [None]", (DAY, "a", 0): "topic: [None, 'z', 'b']",
        (DAY, "a", 1): "topic: ['d']", (None, None, 1): "topic: ['c']",
    }
    assert insight.ask_for_blocks(lines.limit(0), backend).count() == 0


def test_line_tables_keep_their_tasks(spark):
    """Few bytes of lines are much work for the table function; they are not merged into a few tasks."""
    blocks = spark.range(40).select(F.lit(DAY).alias("run_date"), F.lit("a").alias("env"), F.col("id").alias("part"), F.lit(BLOCK).alias("text"))
    rows = insight.block_rows_by_line(blocks)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.count() == 40 * insight.block_rows(blocks.limit(1)).count()


def test_repeated_file_names_double_nothing(spark):
    calls = spark.sparkContext.accumulator(0)
    tasks = spark.createDataFrame([(0, "ask", "a.txt", "", ""), (1, "ask", "", "", "")],
                                  "idx long, request string, filename string, agent string, language string")
    captures = spark.createDataFrame([(0, "fine", "No"), (1, "fine", "No")], "idx long, answer string, timeout_states string")
    for c in ("shared_link", "prep_time", "completion_time", "error"):
        captures = captures.withColumn(c, F.lit(None).cast("string"))
    captures = captures.withColumn("stopped", F.lit(False))
    corpus = spark.createDataFrame([("/x/a.txt", "a.txt", "first"), ("/y/a.txt", "a.txt", "second")],
                                   "path string, file_name string, text string")
    catalog = spark.createDataFrame([("Chat", ["聊天"], 0)], "en string, tc array<string>, pos long")

    def backend(calls=calls):
        def reply(row):
            calls.add(1)
            return '{"evaluation": "%s"}' % row["document"]
        return reply

    prepared = evaluate.prepare(tasks, corpus, catalog, ["idx"])
    got = {r.idx: r.evaluation for r in evaluate.evaluate(prepared, captures, corpus, ["idx"], backend).collect()}
    assert got == {0: "first", 1: S.NO_DOCUMENT} and calls.value == 2


def test_block_cells(spark):
    text = '\n"Quoted ""x"", with\nline end",Matching Test IDs\r\n"a ""b""","1,\n2",3,text 4\nlong,12345678901234567890123,7\n\nx,1'
    df = spark.createDataFrame([(DAY, "a", text), (DAY, "a", None)], "run_date date, env string, text string")
    got = [(r.kind, r["first"], r.ids, r.texts) for r in insight.block_rows(df).orderBy("row_no").collect()]
    assert got == [
        ("heading", 'Quoted "x", with\nline end', None, ["Matching Test IDs"]),
        ("ids", 'a "b"', [1, 2, 3], ["text 4"]),
        ("ids", "long", [7], []),
        ("text", "x", None, ["1"]),
    ]


@pytest.mark.parametrize("per_call", [40, 1000])
def test_one_list_of_issues_per_run(spark, per_call):
    """Parts name one issue in many ways; the lists become one and no id is lost."""
    lines = spark.range(1, 6001).select(
        F.lit(DAY).alias("run_date"), F.when(F.col("id") <= 5900, "a").otherwise("b").alias("env"),
        F.col("id").alias("label"),
    )

    def backend():
        def reply(topic, part):
            assert topic == "merge" and len(part) <= per_call
            groups = {}
            for line in part:
                number, name = line[len("[Issue: "):].split("] ", 1)
                groups.setdefault(f"Kind {name.split()[1]}", []).append(number)
            rows = "\n".join(f'{name},"{", ".join(ids)}",x' for name, ids in groups.items())
            return f"---BLOCK1_START---\nIssue,Matching Test IDs,Example\n{rows}\n---BLOCK1_END---"
        return reply

    def first(topic, part):
        raise AssertionError

    parts = lines.withColumn("part", F.floor(F.col("label") / 100)).select("run_date", "env", "part", F.lit("ids").alias("kind"),
        F.concat(F.lit("Kind "), (F.col("label") % 7).cast("string"), F.lit(" of part "), F.floor(F.col("label") / 100).cast("string")).alias("first"),
        F.array("label").alias("ids"), F.array(F.lit("x")).alias("texts"))
    merged = insight.merge_issues(parts, backend, lines_per_call=per_call)
    got = merged.groupBy("env", "issue").agg(F.count("*").alias("n")).collect()
    assert {(r.env, r.issue): r.n for r in got if r.env == "a"} == {("a", f"Kind {k}"): sum(i % 7 == k for i in range(1, 5901)) for k in range(7)}
    assert merged.count() == 6000 == merged.select("id").distinct().count()
    silent = insight.merge_issues(parts, lambda: (lambda topic, part: "nothing"), lines_per_call=per_call)
    assert silent.count() == 6000 and silent.select("env", "issue").distinct().count() == parts.select("env", "first").distinct().count()
    one = parts.where("part = 3")
    assert {r.issue for r in insight.merge_issues(one, first).collect()} == {f"Kind {k} of part 3" for k in range(7)}


def marks_backend():
    """A judge that needs no service: it reports the marks it sees in the answer."""

    def reply(row: dict) -> str:
        cites = bool(re.search(r"\[\d+\]", row["answer"]))
        verdict = {
            "tester_expectation": "Good" if cites else "Pass",
            "document_contain_citations": "Pass" if cites else "None",
            "evaluation": f"{len(row['answer'])} characters",
        }
        return f"verdict: {json.dumps(verdict)}"

    return reply


def failing_backend():
    """The same judge behind a service that fails: now and then, late, or for good."""
    good = marks_backend()
    tries: dict[str, int] = {}

    def reply(row: dict) -> str:
        key = row["document"]
        tries[key] = tries.get(key, 0) + 1
        size = len(key)
        if size % 5 == 0:
            raise TimeoutError("no answer from judge")
        if size % 5 == 1 and tries[key] % 2 == 1:
            return "busy, try later"
        if size % 5 == 2:  # replies that are no verdict, and none at last
            if tries[key] % 3 == 0:
                raise TimeoutError("no answer from judge")
            return f"busy {tries[key] % 3}"
        return good(row)

    return reply


def test_retries_against_a_failing_service(spark):
    """A service that fails now and then, late or for good; calls come one at a time."""
    texts = {i: "x" * (5 + i) for i in range(10)}
    rows = spark.createDataFrame([(i, "q", t + " [1]", t, "") for i, t in texts.items()], "doc_id long, request string, answer string, document string, target_language string")
    replies = judge.ask(rows, failing_backend, ["doc_id"], wait=lambda s: None, in_flight=1)
    got = {r.doc_id: r for r in judge.parse_verdict(replies).collect()}
    for i, text in texts.items():
        k = len(text) % 5
        assert got[i].attempts == {0: 3, 1: 2, 2: 3}.get(k, 1)
        assert got[i].tester_expectation == ("Parse Error(Failed)" if k in (0, 2) else "Good")
        reply = {0: judge.FAILURE_NO_REPLY, 2: "busy 2"}.get(k)
        want = f"{judge.FAILURE_TEXT}no answer from judge{judge.FAILURE_REPLY}{reply}" if reply else f"{len(text) + 4} characters"
        assert got[i].evaluation == want


def test_logged_calls_are_settled_as_live_ones(spark):
    good = '{"tester_expectation": "Good"}'
    logs = {
        1: [("busy", None), (good, None), ("later", None)], 2: [(None, "down")] * 3 + [(good, None)],
        3: [("a", None), (None, "late"), ("{}}", None)], 4: [(None, "down")], 5: [(good, None)],
    }
    calls = [(k, n, *c) for k, log in logs.items() for n, c in enumerate(log, start=1)]
    df = spark.createDataFrame(calls, "doc_id long, attempt long, reply string, error string").repartition(3)
    got = {r.doc_id: (r.reply, r.attempts, r.error) for r in judge.settled(df, ["doc_id"]).collect()}
    assert got == {
        1: (good, 2, None), 2: (None, 3, "down"), 3: ("{}}", 3, "no JSON object in reply"), 4: (None, 1, "down"), 5: (good, 1, None),
    }
    assert judge.settled(df.limit(0), ["doc_id"]).count() == 0


def test_table_function_equals_the_arrays(spark):
    """Random blocks with quoted commas and line ends, quotes that never close, blank rows and tables."""
    rng = random.Random(12)
    pieces = ["a", "1", "2, 3", '"4,5"', '"x ""y"" z"', '"two\nlines, one"', '"open', "Matching Test IDs", "", " ", ",", "\n", "\n", "\r\n", '""', '"a""', "b\"c", "\t"]
    texts = ["".join(rng.choice(pieces) + rng.choice([",", ",", "\n", ""]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [BLOCK, "", "\n\n", None, '"never closed, 1\nMatching Test IDs\n2,3']
    df = spark.createDataFrame([(DAY, "a", i, t) for i, t in enumerate(texts)], "run_date date, env string, part long, text string")
    key = lambda r: (r.part, r.row_no)
    arrays = insight.block_rows(df).drop("text")
    want = sorted(arrays.collect(), key=key)
    got = sorted(insight.block_rows_by_line(df).select(arrays.columns).collect(), key=key)
    for a, b in zip(want, got):
        assert a == b, (texts[a.part], a, b)
    assert len(got) == len(want) > 500
