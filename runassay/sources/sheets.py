"""Test cases out of headerless sheets held as a long grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions.language import language_headings
from runassay.functions.text import cell, stripped
from runassay.scale import number_rows, pin
from runassay.sources.records import cells, scan_records


def read_grid(spark, path: str) -> DataFrame:
    """CSV sheets of any width as ``grid(path, row_no, col_no, value)``.

    Records are read by as many tasks as the sheets have blocks, and numbered in file order.
    """
    records, _, width = scan_records(spark, path)
    rows = records.select(F.col("file").alias("path"), "block", "at", cells(F.col("text"), width).alias("cells"))
    numbered = number_rows(rows, ["path"], ["block", "at"], name="row_no")
    return numbered.select("path", "row_no", F.posexplode("cells").alias("_pos", "value")).select(
        "path", "row_no", (F.col("_pos") + 1).cast("bigint").alias("col_no"), "value"
    ).where(F.col("value").isNotNull())


def infer_header(grid: DataFrame) -> DataFrame:
    """One header row per sheet: the first row with a request or file heading.

    Anchors are found by a filter and a minimum per sheet. Only the cells of
    the header rows are kept, and written, for the look at their words.
    """
    anchors = [S.REQUEST_HEADING, *S.FILE_HEADINGS]
    first = (
        grid.where(cell("value").isin(anchors))
        .groupBy("path")
        .agg(F.min("row_no").alias("row_no"))
    )
    heads = pin(
        grid.join(first, ["path", "row_no"]).select(
            "path", "row_no", "col_no", cell("value").alias("word")
        ),
        "headings",
    )
    known = [*anchors, S.AGENT_HEADING]
    other = F.when((F.col("word") != "") & ~F.col("word").isin(known), F.col("word"))
    languages = language_headings(heads.select(other.alias("value"))).where("is_language")
    named = heads.join(
        languages.withColumnRenamed("word", "_word"), other == F.col("_word"), "left"
    )

    def last(condition):
        return F.max(F.when(condition, F.col("col_no")))

    word = F.col("word")
    return named.groupBy("path", "row_no").agg(
        last(word == S.REQUEST_HEADING).alias("req_col"),
        last(word.isin(S.FILE_HEADINGS)).alias("file_col"),
        last(word == S.AGENT_HEADING).alias("agent_col"),
        last(F.col("is_language")).alias("lang_col"),
    )


def read_testcases(grid: DataFrame, header: DataFrame) -> DataFrame:
    """Stripped rows below the header that have a request or a file name.

    Cells meet on (path, row_no), never on the path alone, so one large sheet is spread
    like many small ones. Of a cell that is given twice the greatest text counts.
    """
    body = grid.join(header.withColumnRenamed("row_no", "header_row"), "path").where(
        F.col("row_no") > F.col("header_row")
    )

    def at(column: str):
        value = F.max(F.when(F.col("col_no") == F.col(column), stripped("value")))
        return F.coalesce(value, F.lit(""))

    return (
        body.groupBy("path", "row_no")
        .agg(
            at("req_col").alias("request"),
            at("file_col").alias("filename"),
            at("agent_col").alias("agent"),
            at("lang_col").alias("language"),
        )
        .where((F.col("request") != "") | (F.col("filename") != ""))
    )


def assign_labels(testcases: DataFrame, by: str = "path", order: str = "row_no") -> DataFrame:
    """``idx`` from 0 and ``label`` from 1 in sheet order."""
    return number_rows(testcases, [by], [order], name="idx", start=0).withColumn(
        "label", F.col("idx") + 1
    )
