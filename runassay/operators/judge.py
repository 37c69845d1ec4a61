"""Scoring answers in batch: a pluggable judge, retries, verdict parsing and audit."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runassay import schema as S
from runassay.functions.language import named_language
from runassay.functions.text import (
    has_citation,
    has_reference,
    json_body,
    judge_document,
    stripped,
)
from runassay.scale import ship_package, spread

ATTEMPTS = 3
INPUTS = ["request", "document", "answer", "target_language"]

# Texts of a verdict that could not be had.
FAILURE_TEXT = "API调用失败。错误: "
FAILURE_REPLY = "。 接口返回: "
FAILURE_NO_REPLY = "无返回数据"
PARSE_ERROR_LANGUAGE = "Parse Error"

Backend = Callable[[dict], str]


PROMPT_HEAD = (
    "Judge the answer below. Name the language of the question and of the answer, "
    "say whether they agree (Pass/Failed), rate the answer as one of "
    + ", ".join(S.RATINGS)
    + " (at most Poor if the languages disagree), comment in 50 to 100 characters, "
    "and tell whether sources are listed (Pass/N/A) and whether the text carries "
    "[n] marks (Pass/None). Reply with one JSON object with the keys "
    + ", ".join(S.VERDICT_FIELDS)
    + ".\nQuestion:\n"
)


def judge_prompt(document_chars: int | None = None) -> Column:
    """One prompt text per row out of request, target_language, document and answer.

    The document goes in whole unless ``document_chars`` bounds it.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(
        F.lit(PROMPT_HEAD),
        blank("request"),
        F.lit("\nTarget language:\n"),
        blank("target_language"),
        F.lit("\nDocument:\n"),
        judge_document(F.coalesce(F.col("document"), F.lit(S.NO_DOCUMENT)), document_chars),
        F.lit("\nAnswer:\n"),
        blank("answer"),
    )


def rule_verdict(rows: DataFrame) -> DataFrame:
    """Verdict fields by rules on scripts and marks; needs no model and no Python."""
    status = F.when(
        F.col("input_language") == F.col("output_language"), "Pass"
    ).otherwise("Failed")
    cites = has_citation("answer")
    refers = has_reference("answer")
    rating = (
        F.when(stripped(F.coalesce("answer", F.lit(""))) == "", "Failed")
        .when(F.col("language_status") == "Failed", "Poor")
        .when(cites & refers, "Excellent")
        .when(cites | refers, "Good")
        .otherwise("Pass")
    )
    named = rows.withColumns(
        {"input_language": named_language("request"), "output_language": named_language("answer")}
    ).withColumn("language_status", status)
    return named.withColumns(
        {
            "tester_expectation": rating,
            "reference_link": F.when(refers, "Pass").otherwise("N/A"),
            "document_contain_citations": F.when(cites, "Pass").otherwise("None"),
            "evaluation": F.concat(
                F.lit("rule check: "), F.col("input_language"), F.lit(" > "),
                F.col("output_language"),
            ),
        }
    )


def _one_object(reply: str) -> str:
    start, end = reply.find("{"), reply.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no JSON object in reply")
    body = reply[start : end + 1]
    json.loads(body)
    return body


def attempt(
    call: Callable[[], str],
    check: Callable[[str], object],
    attempts: int = ATTEMPTS,
    wait: Callable[[float], None] = time.sleep,
) -> tuple[str | None, int, str | None]:
    """Last reply, number of tries and last error of a call whose reply must pass ``check``.

    Between tries it waits 2, then 4 seconds and so on, plus a jitter.
    """
    reply, error = None, None
    for tried in range(1, attempts + 1):
        try:
            reply = call()
            check(reply)
            return reply, tried, None
        except Exception as e:
            error = str(e)
            if tried < attempts:
                wait(2**tried + random.uniform(0.5, 2.0))
    return reply, attempts, error


def ask(
    rows: DataFrame,
    open_backend: Callable[[], Backend],
    keys: list[str],
    partitions: int | None = None,
    attempts: int = ATTEMPTS,
    wait: Callable[[float], None] = time.sleep,
    in_flight: int = 8,
    document_chars: int | None = None,
) -> DataFrame:
    """Calls the judge once per row: keys, reply, attempts, error.

    Rows are spread by key over ``partitions`` tasks (default: the shuffle
    partitions). Each task opens one backend and streams its rows through it,
    ``in_flight`` calls at a time. A call or reply that fails is tried again; a
    row that still fails keeps its last reply and error, the job goes on.
    """
    ship_package(rows.sparkSession)
    schema = T.StructType(
        rows.select(*keys).schema.fields
        + [
            T.StructField("reply", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = open_backend()

        def one(row: dict) -> tuple:
            return attempt(lambda: backend(row), _one_object, attempts, wait)

        with ThreadPoolExecutor(in_flight) as calls:
            for batch in batches:
                out = list(calls.map(one, batch[INPUTS].to_dict("records")))
                yield pd.concat(
                    [
                        batch[keys].reset_index(drop=True),
                        pd.DataFrame(out, columns=["reply", "attempts", "error"]),
                    ],
                    axis=1,
                )

    asked = rows.select(*keys, *[c for c in INPUTS if c not in keys]).withColumn(
        "document", judge_document("document", document_chars)
    )
    placed = asked.repartition(partitions, *keys) if partitions else spread(asked, *keys)
    return placed.mapInPandas(score, schema)


def settled(calls: DataFrame, keys: list[str], attempts: int = ATTEMPTS) -> DataFrame:
    """What a log of calls comes to: keys, reply, attempts, error, as :func:`ask` gives them.

    In: keys, ``attempt`` from 1, ``reply`` (null: none came) and ``error`` (null: none). The first
    reply with one JSON object counts. Where none has one, the last reply and the last error
    of the first ``attempts`` calls stand; later calls were never due.
    """
    good = json_body("reply").isNotNull()
    due = calls.where(F.col("attempt") <= attempts)
    last = F.max_by(F.coalesce("error", F.lit("no JSON object in reply")), "attempt")
    summed = due.groupBy(*keys).agg(
        F.min(F.when(good, F.col("attempt"))).alias("_at"),
        F.min_by(F.when(good, F.col("reply")), F.when(good, F.col("attempt"))).alias("_good"),
        F.max_by("reply", F.when(F.col("reply").isNotNull(), F.col("attempt"))).alias("_last"),
        F.max("attempt").alias("_made"),
        last.alias("_error"),
    )
    return summed.select(
        *keys, F.coalesce("_good", "_last").alias("reply"), F.coalesce("_at", "_made").cast("int").alias("attempts"),
        F.when(F.col("_at").isNull(), F.col("_error")).alias("error"),
    )


def parse_verdict(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Verdict fields out of noisy replies; anything but one JSON object is a parse error."""
    body = json_body(reply)
    error = F.col("error") if "error" in replies.columns else F.lit(None)
    failed = {
        "tester_expectation": F.lit(S.PARSE_ERROR_RATING),
        "input_language": F.lit(PARSE_ERROR_LANGUAGE),
        "output_language": F.lit(PARSE_ERROR_LANGUAGE),
        "language_status": F.lit("Failed"),
        "evaluation": F.concat(
            F.lit(FAILURE_TEXT),
            F.coalesce(error.cast("string"), F.lit("no JSON object in reply")),
            F.lit(FAILURE_REPLY),
            F.coalesce(F.col(reply), F.lit(FAILURE_NO_REPLY)),
        ),
        "reference_link": F.lit("N/A"),
        "document_contain_citations": F.lit("None"),
    }
    # One generator call reads all fields, so each reply is parsed once.
    parsed = replies.withColumn("_body", body).select(
        "*", F.json_tuple("_body", *S.VERDICT_FIELDS).alias(*[f"_{f}" for f in S.VERDICT_FIELDS])
    )
    return parsed.withColumns(
        {
            field: F.when(F.col("_body").isNull(), failed[field]).otherwise(
                F.coalesce(F.col(f"_{field}"), F.lit(default))
            )
            for field, default in S.VERDICT_FIELDS.items()
        }
    ).drop("_body", *[f"_{f}" for f in S.VERDICT_FIELDS])


def judge(
    rows: DataFrame,
    keys: list[str],
    open_backend: Callable[[], Backend] | None = None,
    partitions: int | None = None,
    wait: Callable[[float], None] = time.sleep,
    document_chars: int | None = None,
) -> DataFrame:
    """Verdict per row that needs one; timed-out rows are never sent.

    In: keys, request, document, answer, target_language, timeout_states.
    Without a backend the rules decide and the job stays native.
    """
    from runassay.functions.flags import is_timeout

    live = rows.where(~is_timeout())
    fields = [*keys, *S.VERDICT_FIELDS]
    if open_backend is None:
        return rule_verdict(live).select(*fields)
    replies = ask(live, open_backend, keys, partitions, wait=wait, document_chars=document_chars)
    return parse_verdict(replies).select(*fields)


def audit_verdicts(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """How often verdicts break the rules the judge was given."""
    rating, status = F.col("tester_expectation"), F.col("language_status")
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("verdicts"),
        F.count_if(~rating.isin(S.RATINGS)).alias("odd_ratings"),
        F.count_if((status == "Failed") & rating.isin("Excellent", "Good", "Pass")).alias(
            "rated_above_cap"
        ),
        F.count_if(
            (F.col("input_language") != F.col("output_language")) & (status == "Pass")
        ).alias("unequal_passes"),
    )
