"""Evaluation tables derived from the generic test tables, for queries and checks.

The column rules are plain SQL expressions, shared with the SQL of the checks;
how rows are numbered is Spark's own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runassay.scale import number_rows

RUN_RULES = {
    "run_date": "CAST(ts AS DATE)",
    "env": "CASE WHEN user_id % 2 = 0 THEN 'env_a' ELSE 'env_b' END",
}

EVENT_RULES = {
    "agent_used": "event_type",
    "crash": """CASE WHEN event_type = 'error' AND (value < 20 OR value > 220)
        THEN concat('crash: step ', CAST(event_id % 7 AS STRING), ', element missing')
        ELSE 'No' END""",
    "timeout_states": """CASE WHEN value > 250 THEN 'yes (总时间超时) & yes (生成超时)'
        WHEN value > 200 THEN 'yes (总时间超时)' WHEN value > 160 THEN 'yes (生成超时)'
        ELSE 'No' END""",
    "language_status": "CASE WHEN event_id % 13 = 0 THEN 'Failed' ELSE 'Pass' END",
    "reference_link": "CASE WHEN event_id % 3 = 0 THEN 'Pass' ELSE 'N/A' END",
    "document_contain": "CASE WHEN event_id % 5 = 0 THEN 'Pass' ELSE 'None' END",
    "completion_time": """CASE WHEN event_id % 11 = 0 THEN 'N/A'
        ELSE concat(CAST(value AS STRING), 's') END""",
    "prep_time": "concat(CAST(event_id % 20 AS STRING), 's')",
    "shared_link": "concat('http://example.org/', CAST(event_id AS STRING))",
    "evaluation": """CASE WHEN event_id % 17 = 0 THEN 'Unknown' WHEN event_id % 19 = 0 THEN ''
        ELSE concat('score ', CAST(event_id % 10 + 1 AS STRING)) END""",
}

RATING_RULE = """CASE WHEN toxic = 1 THEN 'Failed' WHEN quality = 0 THEN 'Poor'
    WHEN quality = 1 THEN 'Good' WHEN event_id % 2 = 0 THEN 'Excellent' ELSE 'Pass' END"""

LANGUAGE_RULES = {
    "input_language": "lang",
    "output_language": "CASE WHEN event_id % 13 = 0 THEN concat(lang, '+xx') ELSE lang END",
}

TASK_RULES = {
    "request": "CASE WHEN (conv_id + turn) % 9 = 0 THEN '' ELSE text END",
    "filename": """CASE WHEN (conv_id + turn) % 4 = 0 THEN ''
        WHEN (conv_id + turn) % 4 = 1 THEN concat('DOC_', CAST(conv_id AS STRING), '.TXT')
        WHEN (conv_id + turn) % 4 = 2 THEN concat('doc_', CAST(conv_id AS STRING), '.pdf')
        ELSE concat('missing_', CAST(turn AS STRING), '.csv') END""",
    "language": """CASE conv_id % 5 WHEN 0 THEN 'Traditional Chinese' WHEN 1 THEN 'zh-TW'
        WHEN 2 THEN 'ENG' WHEN 3 THEN 'match' ELSE '' END""",
    "agent": "CASE WHEN conv_id % 6 = 0 THEN '' ELSE concat('nation_', CAST(conv_id % 25 AS STRING)) END",
}

CAPTURE_RULES = {
    "answer": """CASE WHEN conv_id % 10 = 3 THEN '提取文本失败/为空' WHEN conv_id % 24 = 7 THEN NULL
        ELSE text END""",
    "timeout_states": "CASE WHEN conv_id % 15 = 4 THEN 'yes (总时间超时)' ELSE 'No' END",
    "shared_link": "concat('http://example.org/', CAST(conv_id AS STRING))",
    "prep_time": "concat(CAST(conv_id % 7 AS STRING), 's')",
    "completion_time": "concat(CAST(conv_id % 30 AS STRING), '.5s')",
    "error": """CASE WHEN conv_id % 12 = 5 THEN 'No such window' WHEN conv_id % 12 = 7
        THEN concat('element ', CAST(conv_id AS STRING), ' missing') END""",
    "stopped": "conv_id % 40 = 9",
}

CORPUS_RULES = {
    "file_name": """concat('doc_', CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN '.txt'
        WHEN doc_id % 3 = 1 THEN '.csv' ELSE '.docx' END)""",
    "answer": """CASE WHEN doc_id % 4 = 0
        THEN concat(text, ' [1] see http://example.org/', CAST(doc_id AS STRING))
        ELSE text END""",
}

# Chinese text beside the Latin text of the documents, for the language rules.
ANSWER_RULES = {
    "request": """CASE doc_id % 5 WHEN 0 THEN '请用中文回答这个问题' WHEN 1 THEN '請用中文回答這個問題'
        ELSE 'Please answer this question' END""",
    "answer": """CASE doc_id % 7 WHEN 0 THEN '这是简体说明，会对问题给出结论 [1]'
        WHEN 1 THEN '這是繁體說明，會對問題給出結論' WHEN 2 THEN '这是说明 mixed with English words'
        WHEN 3 THEN '' WHEN 4 THEN concat(text, ' see https://example.org/') ELSE text END""",
}

AGENT_RULE = """CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name)
    WHEN 2 THEN concat('国', CAST(n_nationkey AS STRING)) WHEN 3 THEN replace(n_name, 'TI', 'T')
    ELSE 'qqqqq' END"""

STATUS_RULE = """CASE event_type WHEN 'error' THEN 'BROWSER_CLOSED' WHEN 'view' THEN 'SUCCESS'
    WHEN 'click' THEN 'ERROR' WHEN 'signup' THEN 'SKIPPED' ELSE 'STOPPED' END"""

ERROR_RULE = """CASE event_type
    WHEN 'error' THEN concat('Message: No Such Window (session ', CAST(event_id AS STRING), ')')
    WHEN 'view' THEN 'target window already closed'
    WHEN 'click' THEN concat('element ', CAST(event_id AS STRING), ' not found; ', props)
    WHEN 'signup' THEN NULL ELSE 'Connection REFUSED by host' END"""

VERDICT_RULE = """concat('noise {"tester_expectation": "',
    CASE WHEN event_id % 6 = 0 THEN 'Great' WHEN event_id % 2 = 0 THEN 'Good' ELSE 'Poor' END,
    '", "input_language": "', CASE WHEN event_id % 4 = 0 THEN 'English' ELSE 'French' END,
    '", "output_language": "English", "language_status": "',
    CASE WHEN event_id % 7 = 0 THEN 'Failed' ELSE 'Pass' END, '"}',
    CASE WHEN event_id % 10 = 0 THEN '}' ELSE '' END, ' tail')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(rule) for name, rule in rules.items()})


def results(
    spark: SparkSession,
    sf_dir: str,
    ratings: bool = False,
    language: bool = False,
    labels: bool = False,
    texts: bool = False,
) -> DataFrame:
    """One result per event; joins and numbering only where a query needs them."""
    events = table(spark, sf_dir, "events").drop("props")
    out = _rules(events, RUN_RULES)
    if labels:
        # Numbered while narrow: the texts are derived from what was written.
        out = number_rows(out, ["run_date", "env"], ["ts", "event_id"], name="label")
    out = _rules(out, EVENT_RULES)
    if ratings or language or texts:
        documents = table(spark, sf_dir, "documents")
        size = documents.select(F.count(F.lit(1))).scalar()
        out = out.withColumn("doc_id", F.col("event_id") % size)
    if ratings:
        marks = table(spark, sf_dir, "labels")
        out = out.join(marks, "doc_id", "left")
        out = _rules(out, {"tester_expectation": RATING_RULE}).drop("quality", "toxic")
    if language or texts:
        wanted = ["doc_id", *(["lang"] if language else []), *(["text"] if texts else [])]
        out = out.join(documents.select(*wanted), "doc_id")
        if language:
            out = _rules(out, LANGUAGE_RULES).drop("lang")
        if texts:
            out = out.withColumnRenamed("text", "answer")
    return out


def sheet_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with every sheet column; texts are the documents', with quotes and line ends."""
    full = results(spark, sf_dir, ratings=True, language=True, labels=True, texts=True)
    return full.withColumns(
        {
            "request": F.concat(F.lit('"'), F.substring("answer", 1, 40), F.lit('", please')),
            "filename": F.lit(""),
            "selected_language": F.col("input_language"),
        }
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    keyed = _rules(users.withColumn("task_set", F.col("conv_id") % 8), TASK_RULES)
    numbered = number_rows(keyed, ["task_set"], ["conv_id", "turn"], name="idx", start=0)
    return numbered.select(
        "task_set", "idx", "request", "filename", "language", "agent", "conv_id", "turn"
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came back for a user turn: the assistant's next turn, a timeout, or an error."""
    replies = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return _rules(replies.withColumn("turn", F.col("turn") - 1), CAPTURE_RULES).select(
        "conv_id", "turn", *CAPTURE_RULES
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(table(spark, sf_dir, "documents"), CORPUS_RULES).select(
        "file_name", "doc_id", "answer"
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(table(spark, sf_dir, "documents").drop("source", "n_chars", "lang"), ANSWER_RULES)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless sheets: heading on row 3, moving request column, optional language column.

    One pass: every conversation row emits its cells.
    """
    heading = [
        "named_struct('row_no', 1L, 'col_no', 1L, 'value', 'Notes')",
        "named_struct('row_no', 3L, 'col_no', 1 + conv_id % 2, 'value', ' Request ')",
        "named_struct('row_no', 3L, 'col_no', 3L, 'value', 'File Name')",
        "CASE WHEN conv_id % 3 <> 0 THEN "
        "named_struct('row_no', 3L, 'col_no', 4L, 'value', 'Target Language') END",
    ]
    cells = f"""array_compact(concat(
        CASE WHEN turn = 0 THEN array({', '.join(heading)}) ELSE array() END,
        array(CASE role
            WHEN 'user' THEN named_struct('row_no', 4 + turn, 'col_no', 1 + conv_id % 2, 'value', text)
            WHEN 'assistant' THEN named_struct('row_no', 4 + turn, 'col_no', 4L, 'value', 'ENG')
            END)))"""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("path"), F.inline(F.expr(cells))
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS en", "array(concat('国', CAST(n_nationkey AS STRING))) AS tc",
        "CAST(n_nationkey AS BIGINT) AS pos",
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog with repeated keys: brands as names, part names as their translations."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS en", "array(p_name, concat(p_type, ' ', p_name)) AS tc", "p_partkey AS pos"
    )


def raw_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("task_key"),
        F.expr(AGENT_RULE).alias("agent"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'zh-TW' ELSE 'English' END").alias("language"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'env_a' ELSE 'env_b' END").alias("env"),
    )


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent titles on offer per environment: English names here, translations there."""
    return table(spark, sf_dir, "nation").selectExpr(
        "CASE WHEN n_regionkey % 2 = 0 THEN 'env_a' ELSE 'env_b' END AS env",
        "inline(array(named_struct('title', concat('Add ', n_name)), "
        "named_struct('title', concat('加 国', CAST(n_nationkey AS STRING)))))",
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS task_key", "ts", "event_id", "1 + CAST(floor(value / 60) AS BIGINT) AS len"
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        *[f"{rule} AS {name}" for name, rule in RUN_RULES.items()],
        "ts", "event_id", f"{STATUS_RULE} AS status",
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "CAST(ts AS DATE) AS run_date", f"{VERDICT_RULE} AS reply"
    )


CALL_RULES = {
    "reply": f"CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'busy, try later' ELSE {VERDICT_RULE} END",
    "error": "CASE WHEN event_type = 'error' THEN concat('no answer: ', CAST(event_id % 5 AS STRING)) END",
}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of calls: what a user's events of a day are, one after another, to a judge."""
    events = _rules(_rules(table(spark, sf_dir, "events"), {"run_date": RUN_RULES["run_date"]}), CALL_RULES)
    keys = ["user_id", "run_date"]
    return number_rows(events.select(*keys, "ts", "event_id", "reply", "error"), keys, ["ts", "event_id"], name="attempt")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue ids with repeats, for events that ran long."""
    out = _rules(table(spark, sf_dir, "events").where("value > 150"), RUN_RULES)
    return out.selectExpr("run_date", "env", "event_type AS issue", "event_id % 97 AS id")
