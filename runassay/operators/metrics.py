"""Counts, shares and times per run: one partial/final aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions import flags
from runassay.functions.text import percent, seconds, share


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _is_valid() -> Column:
    return ~flags.is_timeout() & ~flags.is_crash()


def _time(pick: Callable[[Column], Column], valid_only: bool = False) -> Column:
    t = seconds("completion_time")
    return F.coalesce(pick(F.when(_is_valid(), t) if valid_only else t), F.lit(0.0))


# Every counted number; a report part names the ones it needs and no other column is read.
AGGREGATES: dict[str, Callable[[], Column]] = {
    "total": lambda: F.count(F.lit(1)),
    "timeouts": lambda: _n(flags.is_timeout()),
    "crashes": lambda: _n(flags.is_crash()),
    "overlap": lambda: _n(flags.is_timeout() & flags.is_crash()),
    "failed": lambda: _n(flags.is_failed()),
    "lang_failed": lambda: _n(flags.is_language_failed()),
    "ref_passed": lambda: _n(flags.is_reference_pass()),
    "doc_passed": lambda: _n(flags.is_document_pass()),
    "ref_passed_strict": lambda: _n(flags.is_reference_pass() & _is_valid()),
    "doc_passed_strict": lambda: _n(flags.is_document_pass() & _is_valid()),
    "total_timeouts": lambda: _n(flags.is_total_timeout()),
    "gen_timeouts": lambda: _n(flags.is_generation_timeout()),
    "timed": lambda: F.count(seconds("completion_time")),
    "fastest": lambda: _time(F.min),
    "slowest": lambda: _time(F.max),
    "mean": lambda: _time(F.avg),
    "mean_valid": lambda: _time(F.avg, valid_only=True),
}

# Numbers that follow from the counted ones. ``valid`` subtracts a row that is both a
# timeout and a crash twice, as the established reports do; ``overlap`` says how often.
DERIVED: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "valid": (
        ("total", "timeouts", "crashes"),
        lambda n, t, c: F.greatest(n - t - c, F.lit(0)).cast("bigint"),
    ),
    "passed": (("valid", "failed"), lambda valid, bad: valid - bad),
    "invalid": (("timeouts", "crashes"), lambda t, c: t + c),
    "lang_passed": (("valid", "lang_failed"), lambda valid, bad: valid - bad),
    "ref_failed": (("valid", "ref_passed"), lambda valid, good: valid - good),
    "doc_none": (("valid", "doc_passed"), lambda valid, good: valid - good),
}

REPORT_NUMBERS = [n for n in (*AGGREGATES, *DERIVED) if n != "mean_valid"]


def run_metrics(
    results: DataFrame, by=None, *more: Column, only: list[str] | None = None
) -> DataFrame:
    """The numbers of the report, or ``only`` some, and ``more`` aggregates, in one pass."""
    by = list(by or S.run_keys(results))
    wanted = list(only or REPORT_NUMBERS)
    needed = list(wanted)
    for name in reversed(DERIVED):
        if name in needed:
            needed += [n for n in DERIVED[name][0] if n not in needed]
    counted = results.groupBy(*by).agg(
        *[make().alias(name) for name, make in AGGREGATES.items() if name in needed], *more
    )
    extra = [c for c in counted.columns if c not in AGGREGATES and c not in by]
    for name, (inputs, rule) in DERIVED.items():
        if name in needed:
            counted = counted.withColumn(name, rule(*[F.col(c) for c in inputs]))
    return counted.select(*by, *wanted, *extra)


def run_counts(results: DataFrame, by=None) -> DataFrame:
    """Total, timeouts, crashes, both, and valid = total - timeouts - crashes, at least 0."""
    return run_metrics(
        results, by, only=["total", "timeouts", "crashes", "overlap", "valid"]
    )


def pass_counts(results: DataFrame, by=None) -> DataFrame:
    """Pass, failed and invalid with shares of all tests."""
    out = run_metrics(results, by, only=["total", "passed", "failed", "invalid"])
    return out.withColumns(
        {
            "passed_share": share("passed", "total"),
            "passed_pct": percent("passed", "total"),
            "failed_pct": percent("failed", "total"),
            "invalid_pct": percent("invalid", "total"),
        }
    )


def _over_valid(results: DataFrame, by, good: str, bad: str, *more: str) -> DataFrame:
    base = F.greatest(F.col("valid"), F.lit(1))
    return run_metrics(results, by, only=["valid", good, bad, *more]).withColumns(
        {
            f"{good}_share": share(F.col(good), base),
            f"{good}_pct": percent(F.col(good), base),
            f"{bad}_pct": percent(F.col(bad), base),
        }
    )


def language_counts(results: DataFrame, by=None) -> DataFrame:
    """Language passes and failures with shares of the valid tests."""
    return _over_valid(results, by, "lang_passed", "lang_failed")


def reference_counts(results: DataFrame, by=None) -> DataFrame:
    """Reference passes over all rows; ``ref_failed`` may go below 0 by that rule.

    ``ref_passed_strict`` counts valid rows only.
    """
    return _over_valid(results, by, "ref_passed", "ref_failed", "ref_passed_strict")


def citation_counts(results: DataFrame, by=None) -> DataFrame:
    """The same for citation marks."""
    return _over_valid(results, by, "doc_passed", "doc_none", "doc_passed_strict")


def response_times(results: DataFrame, by=None) -> DataFrame:
    """Fastest, slowest and mean seconds over all rows, and the mean over valid rows."""
    return run_metrics(
        results, by, only=["fastest", "slowest", "mean", "timed", "mean_valid"]
    )


#: Quantiles of the response time, and the accuracy of their sketches (about 1.3 percent of rank).
QUANTILES = {"p50": 0.5, "p95": 0.95}
SKETCH_SIZE = 200
LEVELS = ("run_date", "env", "agent_used")


def rollup_metrics(results: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Counters and times for every combination of ``levels``, one pass over the rows.

    Rows are counted once, at the finest grain, with a mergeable sketch of the times; the
    coarser grains are sums over those few rows by grouping sets. A level that a row leaves
    open is null and not in ``by``, which names the others. Sketches of finer and coarser rows
    (``times``) may be merged further, so no grain needs the rows again.
    """
    names = ["timeouts", "crashes", "overlap", "failed", "lang_failed", "ref_passed", "doc_passed"]
    has = [c for c in names if c != "failed" or "tester_expectation" in results.columns]
    t = seconds("completion_time")
    counters = {"total": F.count(F.lit(1)), **{c: AGGREGATES[c]() for c in has}}
    cells = results.groupBy(*levels).agg(
        *[make.alias(name) for name, make in counters.items()],
        F.count(t).alias("timed"), F.sum(t).alias("_seconds"), F.min(t).alias("fastest"), F.max(t).alias("slowest"),
        F.kll_sketch_agg_double(t, SKETCH_SIZE).alias("times"),
    )
    sets = [[levels[i] for i in range(len(levels)) if mask >> i & 1] for mask in range(1 << len(levels))]
    rolled = cells.groupingSets([[F.col(c) for c in s] for s in sets], *levels).agg(
        F.grouping_id(*levels).alias("_open"),
        *[F.sum(c).alias(c) for c in (*counters, "timed", "_seconds")],
        F.min("fastest").alias("fastest"), F.max("slowest").alias("slowest"), F.kll_merge_agg_double("times").alias("times"),
    )
    # The bit of a level is set where it is left open, the first level's being the highest.
    kept = [F.when(F.shiftright("_open", len(levels) - 1 - i).bitwiseAND(1) == 0, F.lit(c)) for i, c in enumerate(levels)]
    some = F.col("timed") > 0
    return rolled.select(
        F.concat_ws("+", *kept).alias("by"), *levels, *counters, "timed", "fastest", "slowest",
        F.when(some, F.col("_seconds") / F.col("timed")).alias("mean"),
        *[F.when(some, F.kll_sketch_get_quantile_double("times", F.lit(q))).alias(name) for name, q in QUANTILES.items()],
        "times",
    )
