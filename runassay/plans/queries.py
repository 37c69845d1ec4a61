"""One query per operator over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions import flags, text
from runassay.functions.language import language_headings, named_language
from runassay.operators import agents, compare, insight, judge, labels, matching, metrics
from runassay.operators import outcomes, windows
from runassay.plans import evaluate as EV
from runassay.plans import report as R
from runassay.plans import views as V
from runassay.plans.rule_model import grouping_backend, part_names_backend
from runassay.scale import first_rows, latest_row, open_files, scratch_dir
from runassay.sources import corpus as C
from runassay.sources import reports, sheets
from runassay.sources import results as RS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RUN = S.RUN_KEYS
R_SITE, R_TIME = "http://example.org/", "2024-01-31 00:00"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _n(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# ---- sources and sinks ----


@query
def s1_header(spark, sf):
    return sheets.infer_header(V.grid(spark, sf)).select(
        "path", "row_no", "req_col", "file_col", "agent_col", "lang_col"
    )


@query
def s2_testcases(spark, sf):
    grid = V.grid(spark, sf)
    return sheets.read_testcases(grid, sheets.infer_header(grid))


@query
def w1_label(spark, sf):
    grid = V.grid(spark, sf)
    cases = sheets.read_testcases(grid, sheets.infer_header(grid))
    return sheets.assign_labels(cases).select("path", "row_no", "idx", "label")


@query
def s3_results(spark, sf):
    """Results written as headed CSV sheets per run, read back and normalised.

    The sheets hold whole texts for each result, so they are packed as they are written;
    as a packed sheet is read by one task, a long run has several.
    """
    path = scratch_dir(spark, "sheets")
    sheet = V.sheet_results(spark, sf).select(
        "env", "run_date", *[F.col(c).alias(h) for h, c in S.RESULT_HEADINGS.items()]
    )
    # Sheets of the second environment have their columns in another order, and one less.
    turned = [c for c in reversed(sheet.columns) if c != "Reference Link"]
    with open_files(spark):
        for part in (sheet.where("env = 'env_a'"), sheet.where("env = 'env_b'").select(*turned)):
            (
                part.write.mode("append").partitionBy("env", "run_date").option("header", True)
                .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
                .option("ignoreTrailingWhiteSpace", False).option("maxRecordsPerFile", 50_000)
                .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").csv(path)
            )
    read = RS.read_results(spark, path, fmt="csv")
    return read.groupBy("env", "run_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("label_sum"),
        F.count("reference_link").alias("references"),
        F.count("document_contain").alias("citations"),
        F.count("completion_time").alias("times"),
        F.count("evaluation").alias("evaluations"),
        F.count("filename").alias("filenames"),
        F.count("answer").alias("answers"),
        F.sum(F.char_length("answer")).cast("bigint").alias("answer_chars"),
        F.sum(F.char_length("request")).cast("bigint").alias("request_chars"),
    ).withColumn("run_date", F.col("run_date").cast("date"))


def _document_files(spark, sf) -> str:
    """Documents as text files of at most 500 documents, one folder per language."""
    path = scratch_dir(spark, "corpus")
    V.table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").option(
        "maxRecordsPerFile", 500
    ).text(path)
    return path


@query
def s4_corpus(spark, sf):
    files = C.read_corpus(spark, _document_files(spark, sf))
    newlines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    return (
        files.withColumn("lang", F.regexp_extract("path", "lang=([^/]*)", 1))
        .groupBy("lang", "ext")
        .agg(
            F.sum(newlines).cast("bigint").alias("lines"),
            F.sum(F.char_length("text")).cast("bigint").alias("chars"),
        )
    )


@query
def s5_listing(spark, sf):
    return (
        C.list_corpus(spark, _document_files(spark, sf))
        .withColumn("lang", F.regexp_extract("path", "lang=([^/]*)", 1))
        .groupBy("lang", "ext")
        .agg(F.sum("length").cast("bigint").alias("bytes"))
    )


def _replays(spark, sf) -> DataFrame:
    """Results with an earlier attempt of every row that later changed."""
    final = V.results(spark, sf, labels=True).select(*RUN, "label", "ts", "event_id", "evaluation")
    again = final.where("evaluation LIKE 'score%'").withColumns(
        {"ts": F.expr("ts - INTERVAL 1 HOUR"), "evaluation": F.lit("earlier attempt")}
    )
    return final.unionByName(again)


@query
def w2_latest(spark, sf):
    return RS.latest_results(_replays(spark, sf), ["ts", "event_id"]).select(
        *RUN, "label", "event_id", "evaluation"
    )


@query
def s6_upsert(spark, sf):
    """Two batches landed, the second one twice: the replay must change nothing."""
    table = scratch_dir(spark, "results")
    rows = _replays(spark, sf)
    RS.upsert_results(rows.where("evaluation = 'earlier attempt'"), table, 0)
    final = rows.where("evaluation <> 'earlier attempt'")
    RS.upsert_results(final, table, 1)
    RS.upsert_results(final, table, 1)
    stored = RS.stored_results(spark, table, ["ts", "event_id"])
    return stored.select(*RUN, "label", "event_id", "evaluation")


@query
def s6_merge(spark, sf):
    """Batches merged into the slices they touch: attempts in two parts, results, attempts again."""
    table = scratch_dir(spark, "merged")
    rows = _replays(spark, sf)
    early, final = rows.where("evaluation = 'earlier attempt'"), rows.where("evaluation <> 'earlier attempt'")
    for i, batch in enumerate([early.where("label % 2 = 0"), final, early, final.where("env = 'env_a'")]):
        RS.merge_results(batch, table, i, ["ts", "event_id"])
    return RS.merged_results(spark, table).select(*RUN, "label", "event_id", "evaluation")


@query
def s7_render(spark, sf):
    """The text lines of all reports, with their place."""
    return reports.report_lines(_report(spark, sf))


@query
def s7_written(spark, sf):
    """Reports of two environments, written one after the other, read back as text."""
    path = scratch_dir(spark, "reports")
    report = _report(spark, sf)
    for env in ("env_a", "env_b"):
        reports.write_report(report.where(F.col("env") == env), path)
    lines = spark.read.text(path)
    text = F.replace("value", F.lit("\ufeff"), F.lit(""))
    return lines.select(F.col("run_date").cast("date").alias("run_date"), "env", text.alias("text"))


@query
def s8_layout(spark, sf):
    path = scratch_dir(spark, "runs")
    RS.publish_results(V.results(spark, sf), path)
    runs = spark.read.parquet(path)
    return _n(runs.withColumn("run_date", F.col("run_date").cast("date")), "env", "run_date")


@query
def s9_recover(spark, sf):
    """The report on whatever had landed, read back from the landing table."""
    table = scratch_dir(spark, "results")
    rows = V.results(spark, sf, ratings=True, labels=True)
    RS.upsert_results(rows, table, 0)
    stored = RS.stored_results(spark, table, ["ts", "event_id"])
    return R.summary_report(stored, website=R_SITE, generated=R_TIME)


# ---- predicates ----


def _flag_query(name: str, flag, **views):
    def run(spark, sf):
        rows = V.results(spark, sf, **views)
        return _n(rows.withColumn("flag", flag()), *RUN, "flag")

    run.__name__ = name
    query(run)


_flag_query("p01_timeout", flags.is_timeout)
_flag_query("p02_crash", flags.is_crash)
_flag_query("p03_failed", flags.is_failed, ratings=True)
_flag_query("p04_lang_failed", flags.is_language_failed)
_flag_query("p05_ref_pass", flags.is_reference_pass)
_flag_query("p06_doc_pass", flags.is_document_pass)
_flag_query("p07_total_timeout", flags.is_total_timeout)
_flag_query("p08_gen_timeout", flags.is_generation_timeout)


@query
def p09_evaluable(spark, sf):
    """Evaluable rows as lines with their whole answers."""
    rows = V.results(spark, sf, labels=True, texts=True)
    lines = insight.evaluable(rows)
    return lines.withColumn("text", F.md5("text"))


@query
def p10_lang_samples(spark, sf):
    rows = V.results(spark, sf, language=True, labels=True, texts=True)
    return insight.language_samples(rows)


@query
def o1_samples(spark, sf):
    """First 50 language failures per run, by label."""
    rows = V.results(spark, sf, labels=True).where(flags.is_language_failed_text())
    return first_rows(rows.select(*RUN, "label", "event_id"), RUN, ["label"], S.LANGUAGE_SAMPLES)


def _matched(spark, sf) -> DataFrame:
    return matching.match_files(V.tasks(spark, sf), V.corpus(spark, sf), ["task_set", "idx"])


@query
def j1_j2_file_match(spark, sf):
    return _matched(spark, sf).select("task_set", "idx", "matched_file", "match_kind")


@query
def p11_skip(spark, sf):
    skipped = matching.skipped_results(matching.skip_reason(_matched(spark, sf)))
    return skipped.select(
        "task_set", "idx", "crash", "tester_expectation", "language_status", "answer"
    )


@query
def p12_mode(spark, sf):
    return _n(matching.skip_reason(_matched(spark, sf)), "task_set", "input_mode")


@query
def a12_reconcile(spark, sf):
    return matching.reconcile_files(V.tasks(spark, sf), V.corpus(spark, sf))


@query
def p13_capture(spark, sf):
    rows = V.results(spark, sf, texts=True).withColumn(
        "answer",
        F.when(F.col("event_id") % 23 == 0, S.EMPTY_ANSWER).otherwise(F.col("answer")),
    )
    return _n(
        outcomes.after_capture(rows),
        "run_date", "timeout_states", "needs_judge", "tester_expectation", "evaluation",
    )


def _errors(spark, sf) -> DataFrame:
    return V.table(spark, sf, "events").selectExpr(
        "event_id", "event_type", f"{V.ERROR_RULE} AS error",
        "CASE WHEN event_id % 2 = 0 THEN '未指定' ELSE 'Chat' END AS agent_used",
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS agent",
        "event_id % 29 = 0 AS stopped",
        "CASE WHEN event_id % 31 = 0 THEN 'no input' END AS skip_reason",
    )


@query
def p13_errors(spark, sf):
    rows = _errors(spark, sf).where(F.col("error").isNotNull())
    return outcomes.after_error(rows).select(
        "event_id", "crash", "agent_used", "tester_expectation", "language_status",
        "answer", "evaluation", "timeout_states",
    )


@query
def p14_error_kind(spark, sf):
    rows = _errors(spark, sf).where(F.col("error").isNotNull())
    return _n(rows.withColumn("kind", flags.error_kind("error")), "event_type", "kind")


@query
def p15_status(spark, sf):
    return _n(outcomes.task_status(_errors(spark, sf)), "event_type", "status", "writes_row")


@query
def p16_route(spark, sf):
    return _n(V.tasks(spark, sf).withColumn("is_tc", flags.is_traditional_route()),
              "language", "is_tc")


@query
def p17_state(spark, sf):
    tasks = V.tasks(spark, sf).withColumn("state", flags.resolution_state("agent"))
    return _n(tasks, "task_set", "state")


@query
def p18_defaults(spark, sf):
    return _n(outcomes.with_defaults(V.tasks(spark, sf)), "task_set", "selected_language",
              "agent_used")


# ---- agents ----


@query
def u1_names(spark, sf):
    return agents.valid_names(V.part_catalog(spark, sf))


@query
def u2_folded(spark, sf):
    return agents.folded_names(V.part_catalog(spark, sf))


@query
def u3_inverse(spark, sf):
    return agents.english_names(V.part_catalog(spark, sf))


@query
def a15_duplicates(spark, sf):
    return agents.duplicate_entries(V.part_catalog(spark, sf))


@query
def j3_exact(spark, sf):
    """Exact and case-folded hits only."""
    resolved = agents.resolve_names(V.raw_agents(spark, sf), V.catalog(spark, sf), fuzzy=False)
    return resolved.select("raw", "agent", "how")


@query
def j4_fuzzy(spark, sf):
    return agents.resolve_names(V.raw_agents(spark, sf), V.catalog(spark, sf))


@query
def j5_candidates(spark, sf):
    resolved = agents.resolve_names(V.raw_agents(spark, sf), V.catalog(spark, sf))
    return agents.with_candidates(resolved, V.catalog(spark, sf)).select(
        "raw", "agent",
        F.array_join("tc_candidates", "|").alias("tc_candidates"),
        F.array_join("en_candidates", "|").alias("en_candidates"),
    )


@query
def j5_resolved(spark, sf):
    """Whole resolution per task, counted by its outcome."""
    resolved = agents.resolve_agents(V.raw_agents(spark, sf), V.catalog(spark, sf), ["task_key"])
    return _n(
        resolved.withColumn("candidates", F.array_join("candidates", "|")),
        "agent", "is_tc", "final_agent", "how", "state", "candidates",
    )


@query
def j6_first_available(spark, sf):
    resolved = agents.resolve_agents(V.raw_agents(spark, sf), V.catalog(spark, sf), ["task_key"])
    return agents.first_offered(resolved, V.offered(spark, sf), ["task_key"])


@query
def f9_language_col(spark, sf):
    """Distinct sheet cells and part names tested as language headings."""
    cells = V.grid(spark, sf).select("value").unionByName(
        V.table(spark, sf, "part").select(F.col("p_name").alias("value"))
    ).unionByName(V.table(spark, sf, "nation").select(
        F.concat(F.lit("lan"), F.lower("n_name")).alias("value")
    ))
    return language_headings(cells)


def _evaluated(spark, sf) -> DataFrame:
    corpus = V.corpus(spark, sf).withColumnRenamed("answer", "text")
    keys = ["conv_id", "turn"]
    prepared = EV.prepare(V.tasks(spark, sf), corpus, V.catalog(spark, sf), keys)
    return EV.evaluate(prepared, V.captures(spark, sf), corpus, keys)


@query
def e1_evaluate(spark, sf):
    """Every conversation as a test case: matched, resolved, judged by rules, as sheet rows."""
    rows = _evaluated(spark, sf).drop("task_set")
    return rows.withColumn("answer", F.md5("answer")).withColumn("request", F.md5("request"))


@query
def e2_chain(spark, sf):
    """Test cases in two environments: offered agents, evaluation, landing, report per test set."""
    corpus = V.corpus(spark, sf).withColumnRenamed("answer", "text")
    envs = spark.range(2).selectExpr("concat('env_', chr(97 + CAST(id AS INT))) AS env", "id AS pos")
    keys = ["conv_id", "turn", "env"]
    tasks = compare.fan_out(V.tasks(spark, sf), envs).withColumn("run_date", F.lit("2024-01-31").cast("date"))
    tasks = tasks.withColumn("task_set", F.col("task_set").cast("string"))
    prepared = EV.prepare(tasks, corpus, V.catalog(spark, sf), keys, V.offered(spark, sf))
    captures = compare.fan_out(V.captures(spark, sf), envs)
    rows = EV.evaluate(prepared, captures, corpus, keys)
    table = scratch_dir(spark, "results")
    RS.upsert_results(rows, table, 0)
    stored = RS.stored_results(spark, table, ["conv_id", "turn"])
    return R.summary_report(stored, website=R_SITE, generated=R_TIME)


# ---- fan-out and comparison ----


@query
def j7_fanout(spark, sf):
    """Every test case in every region."""
    envs = V.table(spark, sf, "region").selectExpr("r_name AS env", "r_regionkey AS pos")
    return compare.fan_out(V.tasks(spark, sf).select("task_set", "idx"), envs)


@query
def j8_unwritten(spark, sf):
    """Test cases that left no row in the result table: stopped ones and closed windows."""
    table = scratch_dir(spark, "results")
    _evaluated(spark, sf).write.parquet(table)
    planned = V.tasks(spark, sf).select("conv_id", "turn")
    return compare.unwritten_tasks(planned, spark.read.parquet(table), ["conv_id", "turn"])


@query
def j9_unknown_ids(spark, sf):
    results = V.results(spark, sf, labels=True)
    return _n(labels.known_ids(V.clusters(spark, sf), results), *RUN, "known")


@query
def j10_compare_envs(spark, sf):
    rows = V.results(spark, sf, ratings=True, labels=True)
    return compare.compare_envs(rows, "env_a", "env_b")


# ---- aggregates ----


@query
def a01_counts(spark, sf):
    return metrics.run_counts(V.results(spark, sf)).drop("valid")


@query
def a02_valid(spark, sf):
    return metrics.run_counts(V.results(spark, sf)).select(*RUN, "overlap", "valid")


@query
def a03_pass(spark, sf):
    return metrics.pass_counts(V.results(spark, sf, ratings=True))


@query
def a04_language(spark, sf):
    return metrics.language_counts(V.results(spark, sf))


@query
def a05_reference(spark, sf):
    return metrics.reference_counts(V.results(spark, sf))


@query
def a06_citation(spark, sf):
    return metrics.citation_counts(V.results(spark, sf))


@query
def a07_times(spark, sf):
    times = metrics.response_times(V.results(spark, sf))
    return times.withColumns(
        {"mean": F.round("mean", 6), "mean_valid": F.round("mean_valid", 6)}
    )


@query
def a08_crash_ids(spark, sf):
    return labels.crash_split(V.results(spark, sf, labels=True))


@query
def a09_crash_rows(spark, sf):
    return labels.crash_rows(V.results(spark, sf, labels=True))


@query
def a10_timeout_ids(spark, sf):
    return labels.label_lines(labels.timeout_kinds(V.results(spark, sf, labels=True)))


@query
def a11_clusters(spark, sf):
    totals = metrics.run_counts(V.results(spark, sf))
    return labels.cluster_counts(V.clusters(spark, sf), totals)


@query
def o2_cluster_ids(spark, sf):
    return labels.cluster_lines(V.clusters(spark, sf))


def _report(spark, sf) -> DataFrame:
    rows = V.results(spark, sf, ratings=True, labels=True)
    return R.summary_report(rows, website=R_SITE, generated=R_TIME)


@query
def a13_report(spark, sf):
    return _report(spark, sf)


@query
def a13_rollup(spark, sf):
    """Counters and times per run and agent, per run, day, environment and agent, and in all."""
    rolled = metrics.rollup_metrics(V.results(spark, sf)).drop("times", *metrics.QUANTILES)
    return rolled.withColumn("seconds", F.round(F.col("mean") * F.col("timed"), 2)).drop("mean")


@query
def a14_env_report(spark, sf):
    """The full report of every run of every environment."""
    rows = V.results(spark, sf, ratings=True, labels=True)
    return R.environment_report(rows, website=R_SITE, generated=R_TIME)


# ---- windows ----


@query
def w3_first_match(spark, sf):
    """First document per language and source by file name."""
    files = V.corpus(spark, sf).join(
        V.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id"
    ).select("lang", "source", "file_name", "doc_id")
    return latest_row(files, ["lang", "source"], ["file_name"], first=True)


@query
def w4_stability(spark, sf):
    return windows.stable_at(V.polls(spark, sf))


@query
def w5_breaker(spark, sf):
    return windows.breaker(V.statuses(spark, sf))


@query
def o4_last_text(spark, sf):
    """Newest non-blank text per conversation."""
    turns = V.table(spark, sf, "conversations").where(text.text_length("text") > 0)
    return latest_row(turns.select("conv_id", "turn", "text"), ["conv_id"], ["turn"])


@query
def o5_first_envs(spark, sf):
    return (
        V.table(spark, sf, "nation").selectExpr("n_name AS env", "n_nationkey AS pos")
        .orderBy("pos").limit(S.MAX_ENVIRONMENTS)
    )


# ---- scalar functions ----


@query
def f01_cell(spark, sf):
    return V.grid(spark, sf).select("path", "row_no", "col_no", text.cell("value").alias("cell"))


@query
def f02_names(spark, sf):
    return V.corpus(spark, sf).select(
        "file_name", text.base_name("file_name").alias("base"), text.extension("file_name").alias("ext")
    )


@query
def f03_excerpt(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", text.excerpt("text").alias("excerpt"))


@query
def f04_judge_document(spark, sf):
    """Document part of the judge input, over texts doubled to pass its limit."""
    long = F.concat(F.col("text"), F.col("text"))
    return V.table(spark, sf, "documents").select(
        "doc_id",
        F.char_length(text.judge_document(long)).cast("bigint").alias("chars"),
        F.md5(text.judge_document(long)).alias("digest"),
    )


@query
def f05_clean(spark, sf):
    dirty = F.expr("concat(chr(7), text, chr(31), chr(9), 'x', chr(11))")
    return V.table(spark, sf, "documents").select(
        "doc_id", F.md5(text.clean_text(dirty)).alias("digest")
    )


@query
def f06_csv_safe(spark, sf):
    return _n(V.results(spark, sf).select(text.csv_safe("crash").alias("reason")), "reason")


@query
def f07_seconds(spark, sf):
    return V.results(spark, sf).select("event_id", text.seconds("completion_time").alias("seconds"))


@query
def f08_percent(spark, sf):
    """Share of every user's events in all events of the day, as number and text."""
    days = _n(V.results(spark, sf).select("run_date"), "run_date").withColumnRenamed("n", "total")
    users = _n(V.results(spark, sf), "run_date", "user_id")
    return users.join(days, "run_date").select(
        "run_date", "user_id", "n", "total",
        text.share("n", "total").alias("share"), text.percent("n", "total").alias("pct"),
    )


@query
def f10_json_body(spark, sf):
    return V.verdicts(spark, sf).select("event_id", text.json_body("reply").alias("body"))


@query
def f11_block(spark, sf):
    reply = F.concat(
        F.lit("intro ---BLOCK1_START--- \n"), F.col("text"),
        F.lit("\n---BLOCK1_END--- later ---BLOCK1_END---"),
    )
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.md5(text.block(reply, 1)).alias("first"), text.block(reply, 2).alias("second"),
    )


@query
def f12_numbers(spark, sf):
    cells = V.table(spark, sf, "events").select(
        "event_id", F.expr("concat(CAST(event_id AS STRING), ', \"', CAST(user_id AS STRING), '\"')")
        .alias("ids"), "props",
    )
    return cells.select(
        "event_id",
        F.array_join(text.numbers("ids"), "|").alias("numbers"),
        text.is_id_cell("ids").alias("is_ids"),
        text.is_id_cell("props").alias("props_is_ids"),
    )


@query
def f13_page_times(spark, sf):
    html = F.concat(
        F.col("html"),
        F.expr("CASE WHEN page_id % 3 <> 0 THEN concat('<number-flow class=\"a\" value=\"', "
               "CAST(page_id AS STRING), '.5\"></number-flow>') ELSE '' END"),
        F.expr("CASE WHEN page_id % 3 = 1 THEN '<NUMBER-FLOW aria-valuenow=7.25>' ELSE '' END"),
    )
    prep, done = text.page_times(html)
    return V.table(spark, sf, "pages").select(
        "page_id", prep.alias("prep_time"), done.alias("completion_time")
    )


@query
def f14_error_texts(spark, sf):
    """Long texts as judge errors and as crash messages."""
    rows = V.table(spark, sf, "documents").select("doc_id", F.col("text").alias("error"))
    return outcomes.judge_failed(rows).select(
        "doc_id", "evaluation",
        F.concat(F.lit(S.CRASH_PREFIX), F.substring("error", 1, 150)).alias("crash"),
    )


@query
def f15_f16_marks(spark, sf):
    return V.corpus(spark, sf).select(
        "doc_id", text.has_citation("answer").alias("cites"),
        text.has_reference("answer").alias("refers"),
    )


@query
def f17_length(spark, sf):
    padded = F.concat(F.lit(" \n"), F.col("text"), F.lit("\t "))
    return V.table(spark, sf, "documents").select("doc_id", text.text_length(padded).alias("chars"))


@query
def f18_lines(spark, sf):
    """Labelled lines of all results, whatever their state."""
    rows = V.results(spark, sf, language=True, texts=True).withColumn("label", F.col("event_id"))
    return rows.select(
        "event_id", F.md5(text.evaluation_line()).alias("eval_line"),
        F.md5(text.language_line()).alias("lang_line"),
    )


@query
def f19_mix(spark, sf):
    rows = V.results(spark, sf, language=True)
    return _n(rows.select(F.explode(text.language_mix("output_language")).alias("language")),
              "language")


# ---- judge and insight ----


@query
def x3_parse(spark, sf):
    return judge.parse_verdict(V.verdicts(spark, sf)).drop("reply")


@query
def x4_audit(spark, sf):
    return judge.audit_verdicts(judge.parse_verdict(V.verdicts(spark, sf)), ["run_date"])


@query
def x5_rules(spark, sf):
    return judge.rule_verdict(V.answers(spark, sf)).select("doc_id", *S.VERDICT_FIELDS)


def _judge_rows(spark, sf) -> DataFrame:
    return V.answers(spark, sf).select(
        "doc_id", "request", "answer", F.col("text").alias("document"),
        F.lit("").alias("target_language"),
        F.expr("CASE WHEN doc_id % 9 = 0 THEN 'yes (生成超时)' ELSE 'No' END").alias("timeout_states"),
    )


@query
def x1_judge(spark, sf):
    """Verdicts of the default judge, the rules; late rows are not sent."""
    return judge.judge(_judge_rows(spark, sf), ["doc_id"])


@query
def x2_retry(spark, sf):
    """What logged calls come to: tries, error and verdict."""
    settled = judge.settled(V.calls(spark, sf), ["user_id", "run_date"])
    return judge.parse_verdict(settled).select(
        "user_id", "run_date", F.col("attempts").cast("bigint").alias("attempts"), "error", "tester_expectation", "evaluation"
    )


@query
def x9_prompt(spark, sf):
    prompts = _judge_rows(spark, sf).select("doc_id", judge.judge_prompt().alias("prompt"))
    return prompts.select(
        "doc_id", F.char_length("prompt").cast("bigint").alias("chars"),
        F.md5("prompt").alias("digest"),
    )


def _replies(spark, sf) -> DataFrame:
    rows = V.results(spark, sf, labels=True, texts=True)
    return insight.ask_for_blocks(insight.evaluable(rows), grouping_backend)


@query
def x6_insight(spark, sf):
    """The report whose issues, language problems and observations come from a model."""
    rows = V.results(spark, sf, ratings=True, language=True, labels=True, texts=True)
    return R.insight_report(rows, grouping_backend, R_SITE, R_TIME)


@query
def x6_cluster(spark, sf):
    """Clusters by rules over all evaluable rows."""
    return _n(insight.cluster_by_rules(V.results(spark, sf, labels=True)), *RUN, "issue")


@query
def x6_examples(spark, sf):
    return insight.cluster_examples(insight.cluster_by_rules(V.results(spark, sf, labels=True)))


@query
def x7_blocks(spark, sf):
    """Model replies in parts, parsed, merged and counted."""
    rows = insight.block_rows(insight.blocks_of(_replies(spark, sf)))
    return _n(insight.cluster_ids(rows).select(*RUN, "issue", "id").distinct(), *RUN, "issue")


@query
def x6_merged(spark, sf):
    """Issues that the parts of a run name differently, merged: names and tests of each score."""
    lines = insight.evaluable(V.results(spark, sf, labels=True, texts=True))
    replies = insight.ask_for_blocks(lines, part_names_backend, lines_per_call=20)
    rows = insight.block_rows(insight.blocks_of(replies).where("block = 1"))
    merged = insight.merge_issues(rows, part_names_backend)
    score = F.regexp_extract("issue", "^Score \\d+", 0)
    return merged.groupBy(*RUN, score.alias("issue")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("issue").alias("lists")
    )


@query
def x7_table(spark, sf):
    """The same replies by the table function over their lines."""
    rows = insight.block_rows_by_line(insight.blocks_of(_replies(spark, sf)))
    return _n(insight.cluster_ids(rows).select(*RUN, "issue", "id").distinct(), *RUN, "issue")


@query
def x8_fallback(spark, sf):
    """Blocks the replies lack, and replies that never came."""
    replies = V.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn",
        "CASE WHEN role = 'user' THEN concat('---BLOCK2_START---', text, '---BLOCK2_END---') END AS reply",
    )
    blocks = insight.blocks_of(replies)
    return blocks.select(
        "conv_id", "turn", F.col("block").cast("bigint").alias("block"), "name",
        F.md5("text").alias("digest"),
    )


@query
def x5_languages(spark, sf):
    texts = V.answers(spark, sf).select(
        named_language("request").alias("asked"), named_language("answer").alias("given")
    )
    return _n(texts, "asked", "given")
