"""What a captured answer or an error message makes of a result row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions import flags


def after_capture(captured: DataFrame) -> DataFrame:
    """Timeout state and judge need of captured answers.

    In: answer, timeout_states. An empty extraction adds the generation
    timeout; a timed-out row is failed and never goes to the judge.
    """
    empty = F.coalesce(F.col("answer") == S.EMPTY_ANSWER, F.lit(False))
    state = F.when(
        empty,
        F.when(F.col("timeout_states") == "No", F.lit(S.GENERATION_TIMEOUT)).otherwise(
            F.concat(F.col("timeout_states"), F.lit(f" & {S.GENERATION_TIMEOUT}"))
        ),
    ).otherwise(F.col("timeout_states"))
    out = captured.withColumn("timeout_states", state)
    timeout = flags.is_timeout()
    return out.withColumns(
        {
            "needs_judge": ~timeout,
            "tester_expectation": F.when(timeout, "Failed"),
            "language_status": F.when(timeout, "Failed"),
            "evaluation": F.when(timeout, S.TIMEOUT_EVALUATION),
        }
    )


def judge_failed(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows whose judge call raised: ratings unknown, the first 100 characters kept."""
    return rows.withColumns(
        {
            "tester_expectation": F.lit("Unknown"),
            "language_status": F.lit("Unknown"),
            "evaluation": F.concat(F.lit(S.JUDGE_ERROR_PREFIX), F.substring(error, 1, 100)),
        }
    )


def after_error(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows whose run raised: closed windows leave no result, the rest become crashes."""
    crash = F.concat(F.lit(S.CRASH_PREFIX), F.substring(error, 1, 150))
    used = S.RESULT_DEFAULTS["agent_used"]
    return (
        rows.withColumn("status", flags.error_kind(error))
        .where(F.col("status") == "ERROR")
        .withColumns(
            {
                "crash": crash,
                "agent_used": F.when(
                    F.col("agent_used") == used, flags.or_default("agent", used)
                ).otherwise(F.col("agent_used")),
                "tester_expectation": F.lit("Failed"),
                "language_status": F.lit("Failed"),
                "answer": F.lit(S.CRASH_ANSWER),
                "evaluation": crash,
                "timeout_states": F.lit(S.CRASH_TIMEOUT_STATE),
            }
        )
    )


def task_status(rows: DataFrame) -> DataFrame:
    """Status from stopped, skip_reason and error; STOPPED and BROWSER_CLOSED write no row."""
    status = (
        F.when(F.col("stopped"), "STOPPED")
        .when(F.col("skip_reason").isNotNull(), "SKIPPED")
        .when(F.col("error").isNotNull(), flags.error_kind("error"))
        .otherwise("SUCCESS")
    )
    return rows.withColumn("status", status).withColumn(
        "writes_row", ~F.col("status").isin("STOPPED", "BROWSER_CLOSED")
    )


def with_defaults(rows: DataFrame) -> DataFrame:
    """Blank file name, language and agent replaced by their sheet texts."""
    return rows.withColumns(
        {
            "filename": flags.or_default("filename", S.RESULT_DEFAULTS["filename"]),
            "selected_language": flags.or_default(
                "language", S.RESULT_DEFAULTS["selected_language"]
            ),
            "agent_used": flags.or_default("agent", S.RESULT_DEFAULTS["agent_used"]),
        }
    )
