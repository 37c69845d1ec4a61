"""Test cases against the document folder, and what follows from a miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions.text import base_name, cell, stripped
from runassay.scale import null_safe_key


def match_files(tasks: DataFrame, corpus: DataFrame, task_keys: list[str]) -> DataFrame:
    """Adds ``matched_file`` and ``match_kind`` (exact, base, none, blank).

    The corpus is first reduced to one file per name and per base name (least
    name wins), so each task meets at most one row on either side and the
    fallback needs no anti-join. Tasks without a file name carry a salt
    instead of one shared null key.
    """
    names = corpus.select("file_name")
    full = names.groupBy(F.lower("file_name").alias("_full")).agg(
        F.min("file_name").alias("_exact"), F.min(F.lit(0).cast("bigint")).alias("_salt")
    )
    base = names.groupBy(F.lower(stripped(base_name("file_name"))).alias("_base")).agg(
        F.min("file_name").alias("_fallback"), F.min(F.lit(0).cast("bigint")).alias("_salt_b")
    )
    name = cell("filename")
    wanted = F.when(name != "", name)
    key, salt = null_safe_key(wanted, *task_keys)
    keyed = tasks.withColumns({"_key": key, "_key_salt": salt})
    exact = keyed.join(
        full, (F.col("_key") == F.col("_full")) & (F.col("_key_salt") == F.col("_salt")), "left"
    )
    # Only misses keep a base key; hits are spread like blanks.
    miss = F.when(F.col("_exact").isNull(), base_name(F.col("_key")))
    key, salt = null_safe_key(miss, *task_keys)
    both = exact.withColumns({"_base_key": key, "_base_salt": salt}).join(
        base,
        (F.col("_base_key") == F.col("_base")) & (F.col("_base_salt") == F.col("_salt_b")),
        "left",
    )
    kind = (
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_fallback").isNotNull(), "base")
        .when(F.col("_key").isNotNull(), "none")
        .otherwise("blank")
    )
    return both.select(
        *tasks.columns,
        F.coalesce("_exact", "_fallback").alias("matched_file"),
        kind.alias("match_kind"),
    )


def skip_reason(matched: DataFrame) -> DataFrame:
    """Adds ``skip_reason`` (null for tasks that run) and ``input_mode``."""
    no_request = F.coalesce(stripped("request"), F.lit("")) == ""
    no_file = F.col("matched_file").isNull()
    blank = F.col("match_kind") == "blank"
    reason = (
        F.when(no_file & no_request & ~blank, S.SKIP_NO_FILE)
        .when(no_file & no_request & blank, S.SKIP_EMPTY)
    )
    mode = (
        F.when(~no_file, "file")
        .when(reason.isNotNull(), "skipped")
        .when(blank, "text")
        .otherwise("text_degraded")
    )
    return matched.withColumns({"skip_reason": reason, "input_mode": mode})


def skipped_results(classified: DataFrame) -> DataFrame:
    """Result columns of skipped tasks."""
    return classified.where(F.col("skip_reason").isNotNull()).withColumns(
        {
            "crash": F.col("skip_reason"),
            "tester_expectation": F.lit("Failed"),
            "language_status": F.lit("Failed"),
            "answer": F.lit(S.SKIP_ANSWER),
        }
    )


def reconcile_files(tasks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Supported files against test cases that name one."""
    pattern = rf"[.]({'|'.join(S.CORPUS_EXTENSIONS)})$"
    files = corpus.where(F.lower("file_name").rlike(pattern)).select(
        F.lit(1).alias("is_file"), F.lit(0).alias("is_named"), F.lit(0).alias("is_task")
    )
    named = tasks.select(
        F.lit(0).alias("is_file"),
        F.when(cell("filename") != "", 1).otherwise(0).alias("is_named"),
        F.lit(1).alias("is_task"),
    )
    counted = files.unionByName(named).agg(
        F.coalesce(F.sum("is_file"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("is_named"), F.lit(0)).alias("named"),
        F.coalesce(F.sum("is_task"), F.lit(0)).alias("tasks"),
    )
    return counted.withColumn("mismatch", F.col("files") != F.col("named"))
