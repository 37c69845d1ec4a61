"""Row predicates of a result table as null-safe boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions.text import stripped


def _has(column: str, word: str) -> Column:
    return F.coalesce(F.lower(F.col(column)).contains(word), F.lit(False))


def is_timeout(column: str = "timeout_states") -> Column:
    return _has(column, "yes")


def is_crash(column: str = "crash") -> Column:
    return F.coalesce(F.col(column) != "No", F.lit(False))


def is_language_failed_text(column: str = "language_status") -> Column:
    return _has(column, "failed")


def is_failed() -> Column:
    low = F.coalesce(F.col("tester_expectation").isin(S.FAILED_RATINGS), F.lit(False))
    return (is_language_failed_text() | low) & ~is_timeout() & ~is_crash()


def is_language_failed() -> Column:
    return is_language_failed_text() & ~is_timeout() & ~is_crash()


def is_reference_pass(column: str = "reference_link") -> Column:
    return _has(column, "pass")


def is_document_pass(column: str = "document_contain") -> Column:
    return _has(column, "pass")


def is_total_timeout(column: str = "timeout_states") -> Column:
    return F.coalesce(F.col(column).contains(S.TOTAL_TIMEOUT_MARK), F.lit(False))


def is_generation_timeout(column: str = "timeout_states") -> Column:
    return F.coalesce(F.col(column).contains(S.GENERATION_TIMEOUT_MARK), F.lit(False))


def is_evaluable() -> Column:
    text = stripped(F.coalesce(F.col("evaluation"), F.lit("")))
    return ~is_timeout() & ~is_crash() & ~text.isin("", "Unknown", "nan")


def is_language_sample() -> Column:
    """Language failures fit for samples; crashes stay in, timeouts do not."""
    return (
        is_language_failed_text()
        & ~is_timeout()
        & F.col("input_language").isNotNull()
        & F.col("output_language").isNotNull()
        & F.col("answer").isNotNull()
    )


def is_traditional_route(column: str = "language") -> Column:
    text = F.lower(F.col(column))
    hit = F.lit(False)
    for word in S.TRADITIONAL_ROUTE_WORDS:
        hit = hit | text.contains(word)
    return F.coalesce(hit, F.lit(False))


def resolution_state(agent: str | Column) -> Column:
    agent = F.col(agent) if isinstance(agent, str) else agent
    return F.when(stripped(F.coalesce(agent, F.lit(""))) != "", F.lit("4")).otherwise("2")


def error_kind(column: str) -> Column:
    text = F.lower(F.col(column))
    closed = F.lit(False)
    for message in S.CLOSED_WINDOW_MESSAGES:
        closed = closed | text.contains(message)
    return F.when(F.coalesce(closed, F.lit(False)), "BROWSER_CLOSED").otherwise("ERROR")


def or_default(column: str, default: str) -> Column:
    """The column, or ``default`` where it is null or blank."""
    value = F.col(column)
    return F.when(F.coalesce(stripped(value), F.lit("")) == "", F.lit(default)).otherwise(
        value
    )
