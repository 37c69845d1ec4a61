import datetime

import pytest
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions import flags
from runassay.operators import labels, metrics
from runassay.plans import report as R
from runassay.scale import scratch_dir
from runassay.sources import reports
from runassay.sources.results import normalise_results

DAY = datetime.date(2024, 1, 1)
COLUMNS = (
    "run_date date, env string, label long, crash string, tester_expectation string, language_status string, "
    "evaluation string, reference_link string, document_contain string, completion_time string, "
    "timeout_states string, input_language string, output_language string, answer string"
)


def rows(spark, *changes):
    base = dict(
        run_date=DAY, env="a", crash="No", tester_expectation="Good", language_status="Pass", evaluation="score 8",
        reference_link="Pass", document_contain="None", completion_time="10.0s", timeout_states="No",
        input_language="en", output_language="en", answer="text",
    )
    data = [{**base, "label": i + 1, **change} for i, change in enumerate(changes)]
    return spark.createDataFrame(data, COLUMNS)


def one(df):
    (row,) = df.collect()
    return row


def test_overlap_is_subtracted_twice_and_floored(spark):
    both = dict(crash="boom", timeout_states="yes (总时间超时)")
    got = one(metrics.run_metrics(rows(spark, both, both, {})))
    assert (got.total, got.timeouts, got.crashes, got.overlap, got.valid) == (3, 2, 2, 2, 0)
    assert (got.passed, got.invalid, got.ref_failed) == (0, 4, -3)


def test_all_timeouts(spark):
    late = dict(timeout_states="YES (生成超时)", tester_expectation="Failed", completion_time=None)
    got = one(metrics.run_metrics(rows(spark, late, late)))
    assert (got.valid, got.failed, got.fastest, got.mean) == (0, 0, 0.0, 0.0)
    report = R.summary_report(rows(spark, late, late)).where("section_ord = 7 AND ord BETWEEN 3 AND 5").orderBy("ord")
    assert [r.value for r in report.collect()] == ["0s", "0s", "~0.0s"]


def test_failed_needs_neither_timeout_nor_crash(spark):
    df = rows(
        spark, dict(tester_expectation="Poor"), dict(language_status="language FAILED"),
        dict(tester_expectation="Parse Error(Failed)", crash="boom"),
        dict(tester_expectation="Failed", timeout_states="yes"), dict(tester_expectation=None, language_status=None),
        dict(crash=None),
    )
    got = [r[0] for r in df.orderBy("label").select(flags.is_failed()).collect()]
    assert got == [True, True, False, False, False, False]
    assert [r[0] for r in df.orderBy("label").select(flags.is_crash()).collect()] == [False, False, True, False, False, False]


def test_evaluable(spark):
    df = rows(spark, {}, dict(evaluation=" nan "), dict(evaluation="Unknown"), dict(evaluation=None),
              dict(evaluation="  "), dict(crash="x"))
    assert [r[0] for r in df.orderBy("label").select(flags.is_evaluable()).collect()] == [True] + [False] * 5


def test_missing_columns_get_defaults(spark):
    raw = spark.createDataFrame(
        [("Pass", "Good", "3s", "en", "N/A", "None")],
        ["Language Overall Status", "Tester Expectation", "Completion Time", "Input Language", "Output Language", "answer"],
    )
    row = one(normalise_results(raw))
    assert (row.timeout_states, row.crash, row.evaluation) == ("No", "No", "")
    assert row.output_language is None and row.answer is None and row.reference_link is None
    with pytest.raises(ValueError, match="completion_time"):
        normalise_results(raw.drop("Completion Time"))


def test_timeout_kinds_may_both_hold(spark):
    df = rows(spark, dict(timeout_states="yes (总时间超时) & yes (生成超时)"), {})
    got = {(r.kind, r.label) for r in labels.timeout_kinds(df).collect()}
    assert got == {("timeout", 1), ("total_timeout", 1), ("gen_timeout", 1), ("no_timeout", 2)}


def test_report_text(spark):
    df = rows(spark, dict(crash="a, b"), dict(tester_expectation="Poor", evaluation="score 2"), {})
    report = R.summary_report(df, website="w", generated="g")
    path = scratch_dir(spark, "report")
    reports.write_report(report, path)
    files = spark.sparkContext.wholeTextFiles(f"{path}/env=a/run_date=2024-01-01").sortByKey().collect()
    lines = "".join(t for _, t in files).splitlines()
    assert lines[0] == "﻿System Login & Generation Info,,,"
    assert "Total Tests,3,100%," in lines and "Failed,1,33.33%," in lines
    assert 'Has Crash,1,33.33%,"1"' in lines and ' -> Test ID 1,1,N/A,"a; b"' in lines
    assert 'No Timeout,3,100.00%,"1, 2, 3"' in lines and 'Has Timeout (Total),0,0.00%,"None"' in lines
    assert 'Low score,1,33.33%,"2","score 2"' in lines
    titles = [t for t in R.SECTIONS.values()]
    assert [x.split(",")[0].strip("﻿") for x in lines if x.split(",")[0].strip("﻿") in titles] == titles


def test_reports_of_other_runs_stay(spark):
    path = scratch_dir(spark, "report")
    for env, issue in (("a", 'one, "two"'), ("b", "plain")):
        df = rows(spark, {}).withColumn("env", F.lit(env))
        found = df.select("run_date", "env", F.lit(issue).alias("issue"), F.col("label").alias("id"))
        reports.write_report(R.summary_report(df, clusters=found), path)
    lines = {r.value for r in spark.read.text(path).where("env = 'a'").collect()}
    assert '"one, ""two""",1,100.00%,"1"' in lines
    assert spark.read.text(path).where("env = 'b'").count() > 20


def test_long_lists_continue_on_further_lines(spark):
    df = rows(spark, {}).drop("label").crossJoin(spark.range(1, 2501).withColumnRenamed("id", "label"))
    got = R.summary_report(df).where("item = 'No Timeout' OR (section_ord = 9 AND ord = 3)").orderBy("line").collect()
    assert [(r.item, r.value) for r in got] == [("No Timeout", "2500"), (None, None), (None, None)]
    assert [int(x) for r in got for x in r.ids.split(", ")] == list(range(1, 2501))


def test_report_from_a_model(spark):
    def backend():
        def reply(topic, lines):
            if topic == "observations":
                return "---BLOCK3_START---\nKey Observations,,,\nCount," + str(len(lines)) + "\n---BLOCK3_END---"
            if topic == "languages":
                return "no blocks here"
            return '---BLOCK1_START---\nIssue,Matching Test IDs,Example\nBad,"1, 3",x\nWorse,2,y\n---BLOCK1_END---'
        return reply

    df = rows(spark, {}, dict(language_status="Failed"), {})
    got = R.insight_report(df, backend).where("ord BETWEEN 3 AND 9 AND section_ord IN (3, 5, 10)")
    assert sorted((r.section_ord, r.item, r.value, r.ids) for r in got.collect()) == [
        (3, "Bad", "2", "1, 3"), (3, "Worse", "1", "2"),
        (5, "Common Language Problems", "", None), (5, "Error", "Parsing Failed", None),
        (5, "Problem", "Example", None), (10, "Count", "2", None),
    ]


def test_cluster_counts(spark):
    ids = [("x", i) for i in (10, 2, 7, 2)] + [("y", 99)]
    clusters = spark.createDataFrame(ids, "issue string, id long").select(
        F.lit(DAY).alias("run_date"), F.lit("a").alias("env"), "issue", "id")
    totals = metrics.run_counts(rows(spark, *[{}] * 32))
    got = {r.issue: (r.n, r.pct) for r in labels.cluster_counts(clusters, totals).collect()}
    assert got == {"x": (3, "9.38%"), "y": (1, "3.12%")}
    lines = {r.issue: r.ids for r in labels.cluster_lines(clusters).collect()}
    assert lines["x"] == "2, 7, 10"
    known = {r.label: r.known for r in labels.known_ids(clusters, rows(spark, *[{}] * 32)).collect()}
    assert known[99] is False and known[10] is True


def test_crashed_and_skipped_texts_are_the_fixed_ones():
    assert S.RESULT_DEFAULTS["agent_used"] == "未指定" and len(S.RESULT_HEADINGS) == 18


def test_rollup_of_every_level(spark):
    """Counters of all grains against plain sums, quantiles against the sorted times."""
    import random

    rng = random.Random(3)
    made = []
    for i in range(3000):
        made.append((rng.choice("ab"), rng.choice(["x", "y", None]), rng.expovariate(0.1) if i % 10 else None))
    df = rows(spark, {}).drop("env", "agent_used", "completion_time").crossJoin(
        spark.createDataFrame([(e, a, "N/A" if t is None else f"{t}s") for e, a, t in made], "env string, agent_used string, completion_time string"))
    got = metrics.rollup_metrics(df).collect()
    assert len(got) == 2 * (1 + 2 + 3 + 6)
    for r in got:
        by = r.by.split("+") if r.by else []
        mine = [t for e, a, t in made if ("env" not in by or e == r.env) and ("agent_used" not in by or a == r.agent_used)]
        times = sorted(t for t in mine if t is not None)
        assert (r.total, r.timed) == (len(mine), len(times))
        assert r["mean"] == pytest.approx(sum(times) / len(times)) and (r.fastest, r.slowest) == (times[0], times[-1])
        for value, q in ((r.p50, 0.5), (r.p95, 0.95)):
            assert abs(sum(t <= value for t in times) / len(times) - q) < 0.03


def test_environment_report_of_all_runs_or_the_newest(spark):
    import datetime

    both = rows(spark, {}).unionByName(rows(spark, {}).withColumn("run_date", F.lit(DAY - datetime.timedelta(days=1))))
    assert {r.run_date for r in R.environment_report(both).select("run_date").distinct().collect()} == {DAY, DAY - datetime.timedelta(days=1)}
    assert {r.run_date for r in R.environment_report(both, newest=True).select("run_date").distinct().collect()} == {DAY}


def test_results_are_read_once_for_all_numbers(spark):
    """Evaluations, languages and the narrow copy read the results, nothing else does."""
    read = spark.sparkContext.accumulator(0)
    plain = rows(spark, {}, dict(language_status="Failed"))

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    R.insight_report(plain.mapInArrow(counting, plain.schema), lambda: (lambda topic, lines: "no blocks")).collect()
    assert read.value == 3 * 2


def test_observations_of_many_issues_are_one_set(spark):
    """Over 200 issues go out in parts; their observations are observed once more."""
    def backend():
        def reply(topic, lines):
            if topic == "observations":
                return f"---BLOCK3_START---\nKey Observations,,,\nSeen,{len(lines)} lines\n---BLOCK3_END---"
            if topic == "languages":
                return "no blocks here"
            if topic == "merge":
                return ""
            table = "\n".join(f"Issue {x.split('Test ID: ')[1].split(']')[0]},{x.split('Test ID: ')[1].split(']')[0]},e" for x in lines)
            return f"---BLOCK1_START---\nIssue,Matching Test IDs,Example\n{table}\n---BLOCK1_END---"
        return reply

    df = rows(spark, {}).drop("label").crossJoin(spark.range(1, 451).withColumnRenamed("id", "label"))
    got = R.insight_report(df, backend).where("section_ord = 10 AND item = 'Seen'").collect()
    assert [r.value for r in got] == ["3 lines"]
