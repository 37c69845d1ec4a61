"""Columns, sentinels and fixed texts of test cases, results and verdicts."""

from __future__ import annotations

# ---- fixed values: they must equal the texts in existing sheets and verdicts ----

# Sheet heading -> column name, in sheet order.
RESULT_HEADINGS = {
    "label": "label",
    "Request": "request",
    "filename": "filename",
    "Crash": "crash",
    "Tester Expectation": "tester_expectation",
    "Selected Language": "selected_language",
    "Input Language": "input_language",
    "Output Language": "output_language",
    "Language Overall Status": "language_status",
    "answer": "answer",
    "shared link": "shared_link",
    "DeepSeek评价内容": "evaluation",
    "Selected agent": "agent_used",
    "Reference Link": "reference_link",
    "Document Contain[1][2][3]": "document_contain",
    "Preparation Time": "prep_time",
    "Completion Time": "completion_time",
    "Timeout_States": "timeout_states",
}

RESULT_DEFAULTS = {
    "filename": "",
    "crash": "No",
    "tester_expectation": "Unknown",
    "selected_language": "N/A",
    "input_language": "N/A",
    "output_language": "N/A",
    "language_status": "Unknown",
    "answer": "",
    "shared_link": "N/A",
    "evaluation": "Unknown",
    "agent_used": "未指定",
    "reference_link": "N/A",
    "document_contain": "None",
    "prep_time": "N/A",
    "completion_time": "N/A",
    "timeout_states": "No",
}

# Texts a spreadsheet reader takes for "no value".
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

RATINGS = ["Excellent", "Good", "Pass", "Poor", "Failed"]
FAILED_RATINGS = ["Poor", "Failed", "Parse Error(Failed)"]
PARSE_ERROR_RATING = "Parse Error(Failed)"

TOTAL_TIMEOUT = "yes (总时间超时)"
GENERATION_TIMEOUT = "yes (生成超时)"
TOTAL_TIMEOUT_MARK = "总时间超时"
GENERATION_TIMEOUT_MARK = "生成超时"
CRASH_TIMEOUT_STATE = "Crash (Error)"

SKIP_NO_FILE = "Skipped (No File & No Request)"
SKIP_EMPTY = "Skipped (Empty Request & File)"
SKIP_ANSWER = "【任务跳过】缺少必要输入"
CRASH_ANSWER = "【执行崩溃，未能生成回答】"
CRASH_PREFIX = "⚠️ 自动化执行崩溃: "
EMPTY_ANSWER = "提取文本失败/为空"
TIMEOUT_EVALUATION = "生成超时或提取失败，未能获取有效回答。"
JUDGE_ERROR_PREFIX = "API 评价失败: "
AGENT_NOT_OFFERED = " (未找到，降级为 State 2)"
NO_DOCUMENT = "【无原始文档，用户仅提供了纯文本提问，请仅根据问题本身评估回答是否准确且符合逻辑】"

TRADITIONAL_ROUTE_WORDS = ["繁中", "繁体", "繁體", "traditional chinese", "tc", "zh-tw"]
REQUEST_HEADING = "request"
AGENT_HEADING = "selected agent"
FILE_HEADINGS = ["filename", "file name", "file_name"]
LANGUAGE_HEADINGS = [
    "selected language", "selected_language", "language", "lang", "目標語言",
    "测试语言", "ui语言", "ui language",
]
LANGUAGE_HEADING_PARTS = ["language", "lang", "語言"]
CLOSED_WINDOW_MESSAGES = [
    "window already closed", "target window already closed", "no such window",
    "disconnected", "connection refused", "aborted", "invalid session id",
    "not connected to devtools",
]
CORPUS_EXTENSIONS = ["pdf", "docx", "csv", "txt"]

# Verdict field -> text used when the judge leaves the field out.
VERDICT_FIELDS = {
    "tester_expectation": "Unknown",
    "input_language": "Unknown",
    "output_language": "Unknown",
    "language_status": "Unknown",
    "evaluation": "Unknown",
    "reference_link": "N/A",
    "document_contain_citations": "None",
}

FUZZY_CUTOFF = 0.6
MAX_ENVIRONMENTS = 3
BREAKER_LIMIT = 3
STABLE_POLLS = 5
MAX_POLLS = 300
MAX_READS = 60
WARM_UP_SECONDS = 5
DOCUMENT_CHARS = 50000
EXCERPT_CHARS = 300
LANGUAGE_SAMPLES = 50

# ---- end of fixed values ----

RUN_KEYS = ["run_date", "env"]
# A table may tell runs apart further: by run and by set of test cases.
MORE_RUN_KEYS = ["run_id", "task_set"]


def run_keys(df) -> list[str]:
    """The columns of ``df`` that together name a run."""
    return [c for c in (*RUN_KEYS, *MORE_RUN_KEYS) if c in df.columns]
