"""Report sink: ordered text lines, one folder per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay import schema as S

LINE_ORDER = ["section_ord", "ord", "sort_key", "line"]


def report_line(df: DataFrame) -> Column:
    """One CSV line of a long report row; id lists and examples are always quoted.

    Other fields are quoted where they hold a comma, a quote or a line end.
    """
    ids = F.when(F.col("ids").isNull(), "").otherwise(
        F.concat(F.lit('"'), F.col("ids"), F.lit('"'))
    )

    def text(column: str) -> Column:
        value = F.coalesce(F.col(column).cast("string"), F.lit(""))
        doubled = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(value.rlike('[,"\r\n]'), doubled).otherwise(value)

    example = F.concat(F.lit('"'), F.replace("example", F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", text("item"), text("value"), text("pct"), ids, example)


def report_lines(report: DataFrame) -> DataFrame:
    """Report rows as text, with a byte-order mark ahead of each run's first line."""
    first = (F.col("section_ord") == 1) & (F.col("ord") == 0) & (F.col("line") == 0)
    text = F.concat(F.when(first, "﻿").otherwise(""), report_line(report))
    return report.select(*S.run_keys(report), *LINE_ORDER, text.alias("text"))


def write_report(report: DataFrame, path: str) -> None:
    """Text files whose name order is the line order; a long run takes several files.

    Only the runs in ``report`` are replaced.
    """
    runs = sorted(S.run_keys(report))
    keys = [*runs, *LINE_ORDER]
    (
        report_lines(report)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*runs, "text")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*runs)
        .text(path)
    )
