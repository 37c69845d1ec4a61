"""Document folders: listing and text reading."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions.text import base_name, extension

TEXT_EXTENSIONS = [".txt", ".csv"]
BAD_CHAR = "�"


@contextmanager
def _java_charsets(spark: SparkSession):
    """Let ``decode`` take GBK and mark bad bytes while a plan is being built."""
    wanted = {
        "spark.sql.legacy.javaCharsets": "true",
        "spark.sql.legacy.codingErrorAction": "true",
    }
    before = {k: spark.conf.get(k, "false") for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _files(spark: SparkSession, path: str) -> DataFrame:
    # The folder itself (or its partition folders); what lies deeper is not listed.
    listed = spark.read.format("binaryFile").load(path)
    pattern = rf"[.]({'|'.join(S.CORPUS_EXTENSIONS)})$"
    return listed.where(F.lower("path").rlike(pattern)).withColumn(
        "file_name", F.regexp_extract("path", r"([^/]*)$", 1)
    )


def list_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Supported files by extension in any case; contents are never read."""
    return _files(spark, path).select(
        "path", "file_name", extension("file_name").alias("ext"), "length"
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """File texts: UTF-8, else GBK, else empty. One odd file never fails the job.

    Only text formats are decoded; other supported extensions yield ''.
    """
    files = _files(spark, path)
    ext = extension("file_name")
    with _java_charsets(spark):
        utf8 = F.is_valid_utf8(F.col("content").cast("string"))
        gbk = F.decode("content", "GBK")
        text = (
            F.when(~ext.isin(TEXT_EXTENSIONS), F.lit(""))
            .when(utf8, F.col("content").cast("string"))
            .when(gbk.contains(BAD_CHAR), F.lit(""))
            .otherwise(gbk)
        )
        return files.select(
            "path",
            "file_name",
            base_name("file_name").alias("base_name"),
            ext.alias("ext"),
            F.regexp_replace(text, "\r\n?", "\n").alias("text"),
        )
