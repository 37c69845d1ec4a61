"""Label lists of crashes, timeouts and issue clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions import flags
from runassay.functions.text import csv_safe, percent, share
from runassay.scale import id_lines, line_of, pin


def crash_kinds(results: DataFrame, by=None) -> DataFrame:
    by = by or S.run_keys(results)
    return results.where(flags.is_crash()).select(*by, F.lit("crash").alias("kind"), "label")


def timeout_kinds(results: DataFrame, by=None) -> DataFrame:
    """Long form (run, kind, label): a row may be both a total and a generation timeout."""
    by = by or S.run_keys(results)
    kinds = F.array_compact(F.array(*_timeouts()))
    return results.select(*by, F.explode(kinds).alias("kind"), "label")


def _timeouts() -> list[Column]:
    return [
        F.when(~flags.is_timeout(), "no_timeout"),
        F.when(flags.is_timeout(), "timeout"),
        F.when(flags.is_total_timeout(), "total_timeout"),
        F.when(flags.is_generation_timeout(), "gen_timeout"),
    ]


def listed_kinds(results: DataFrame, by=None) -> DataFrame:
    """Crash and timeout kinds together, one scan."""
    by = by or S.run_keys(results)
    return results.select(
        *by, F.explode(F.array_compact(F.array(F.when(flags.is_crash(), "crash"), *_timeouts()))).alias("kind"), "label"
    )


def crash_split(results: DataFrame, by=None) -> DataFrame:
    """Has/no crash counts with shares of all tests, and the label lines of the crashes.

    One pass over the results: every test is counted in the line its label belongs to, and
    the counts of a run are sums over its lines. A run without a crash has one row without
    labels.
    """
    by = list(by or S.run_keys(results))
    crashed = F.when(flags.is_crash(), F.col("label"))
    lines = pin(
        results.groupBy(*by, line_of("label").alias("line")).agg(
            F.count(F.lit(1)).alias("_tests"),
            F.count(crashed).alias("_crashes"),
            F.array_sort(F.collect_set(crashed)).alias("_ids"),
        ),
        "crash-lines",
    )
    sums = lines.groupBy(*by).agg(
        F.sum("_tests").alias("total"), F.sum("_crashes").alias("crashes")
    )
    listed = lines.where(F.size("_ids") > 0).select(
        *by,
        F.lit("crash").alias("kind"),
        "line",
        F.size("_ids").cast("bigint").alias("n"),
        F.array_join("_ids", ", ").alias("ids"),
    )
    return sums.join(listed, by, "left").select(
        *by, "kind", "line", "n", "ids", "total", "crashes",
        (F.col("total") - F.col("crashes")).alias("no_crashes"),
        percent("crashes", "total").alias("crash_pct"),
        percent(F.col("total") - F.col("crashes"), "total").alias("no_crash_pct"),
    )


def crash_rows(results: DataFrame, by=None) -> DataFrame:
    by = by or S.run_keys(results)
    return results.where(flags.is_crash()).select(
        *by, "label", F.lit(1).cast("bigint").alias("n"), csv_safe("crash").alias("reason")
    )


def label_lines(kinds: DataFrame, by=None) -> DataFrame:
    """Sorted label lists per kind, in lines of bounded length."""
    return id_lines(kinds, [*(by or S.run_keys(kinds)), "kind"])


def cluster_counts(
    clusters: DataFrame, totals: DataFrame, by=None, issue: str = "issue"
) -> DataFrame:
    """Distinct tests per issue with the share of all tests of the run.

    ``clusters`` is long (run, issue, id); ``totals`` has one row per run.
    """
    by = by or S.run_keys(clusters)
    distinct = clusters.select(*by, issue, "id").distinct()
    return (
        distinct.groupBy(*by, issue)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(totals.select(*by, "total"), list(by))
        .select(
            *by, issue, "n", "total",
            share("n", "total").alias("share"),
            percent("n", "total").alias("pct"),
        )
    )


def cluster_lines(clusters: DataFrame, by=None, issue: str = "issue") -> DataFrame:
    """Label lines per issue, with the example of the line's first test if there is one."""
    by = by or S.run_keys(clusters)
    carry = "example" if "example" in clusters.columns else None
    return id_lines(clusters, [*by, issue], label="id", carry=carry)


def known_ids(clusters: DataFrame, results: DataFrame, by=None) -> DataFrame:
    """Distinct cluster ids with ``known``: whether the run has a test of that label."""
    by = by or S.run_keys(clusters)
    ids = clusters.select(*by, F.col("id").alias("label")).distinct()
    labels = results.select(*by, "label", F.lit(True).alias("known"))
    return ids.join(labels, [*by, "label"], "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )
