"""Document rules and host verdicts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import WORD, mapped, pin, slices

#: Symbols that are counted, and the blanks around words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words
#: Further rules that count only for hosts.
MOST_SYMBOLS = 0.5  # per word
MOST_DUP_LINES = 0.5  # of lines with a word
#: A host is rejected if its shrunk rate for any rule exceeds this.
MOST_FAILURES = 0.5
RULES = ("base", "symbols", "dup_lines")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def counts_of(texts: list[str]) -> dict[str, np.ndarray]:
    """Word, symbol, line and repetition counts of each text."""
    find = re.compile(WORD).findall
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    words: list[str] = []
    for i, text in enumerate(texts):
        found = find(text)
        words += found
        out["n_words"][i] = len(found)
        out["word_chars"][i] = sum(map(len, found))
        out["n_symbols"][i] = sum([text.count(c) for c in SYMBOLS])
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if len(words) >= 3:
        doc = np.repeat(np.arange(n), out["n_words"])
        code, distinct = pd.factorize(np.array(words, dtype=object))
        base = len(distinct)
        # Windows are numbered step by step, so equal numbers mean equal words.
        pair, _ = pd.factorize(code[:-2] * base + code[1:-1])
        triple, _ = pd.factorize(pair * base + code[2:])
        own, _ = pd.factorize(triple * n + doc[:-2])
        again = (doc[:-2] == doc[2:]) & _twice(own, doc[:-2] == doc[2:])
        inside = np.zeros(len(words), bool)
        for k in range(3):
            inside[k : len(words) - 2 + k] |= again
        out["n_repeat_words"] = np.bincount(doc[inside], minlength=n)
    return out


def _twice(code: np.ndarray, valid: np.ndarray) -> np.ndarray:
    return np.bincount(code[valid], minlength=int(code.max()) + 1)[code] >= 2


def _with_counts(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = counts_of([t or "" for t in batch.column("text").to_pylist()])
        out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        yield pa.RecordBatch.from_pydict(out | {c: pa.array(found[c], pa.int64()) for c in COUNTS})


def document_counts(documents: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, ``host`` and the counts of each whole text (null: no words)."""
    narrow = documents.select(
        "doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")
    )
    key = narrow.schema["doc_id"].dataType.simpleString()
    return mapped(narrow, _with_counts, f"doc_id {key}, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def failures() -> dict[str, Column]:
    """Rule failures of a row with the counts; none is null."""
    n = F.col("n_words")
    return {
        "base": (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n),
        "symbols": F.col("n_symbols") > MOST_SYMBOLS * n,
        "dup_lines": F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
    }


def host_rates(counts: DataFrame) -> DataFrame:
    """Documents and failures of each host, with shrunk rates and the verdict.

    Each rule's prior is a beta distribution fitted to all hosts by moments: its mean is
    the rate over all documents, and its strength follows from how far the hosts' rates
    spread beyond what chance alone would give.
    """
    hosts = pin(
        counts.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.count_if(f).alias(f"f_{r}") for r, f in failures().items()],
        ),
        "hosts",
    )
    total = hosts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n_docs").alias("n"),
        *[F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES],
        *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n_docs")).alias(f"s_{r}") for r in RULES],
    ).first()
    rejected = F.lit(False)
    out = hosts
    for r in RULES:
        alpha, beta = beta_prior(total["k"], total["n"] or 0, total[f"f_{r}"] or 0, total[f"s_{r}"] or 0.0)
        rate = (F.col(f"f_{r}") + alpha) / (F.col("n_docs") + alpha + beta)
        out = out.withColumn(f"rate_{r}", rate)
        rejected = rejected | (rate > MOST_FAILURES)
    return out.withColumn("host_rejected", rejected)


def beta_prior(hosts: int, docs: int, failed: int, squares: float) -> tuple[float, float]:
    """Moments fit: ``squares`` is the sum of failures squared over documents per host."""
    if not docs:
        return 1.0, 1.0
    mean = min(max(failed / docs, 0.5 / (docs + 1)), 1 - 0.5 / (docs + 1))
    spread = squares / docs - (failed / docs) ** 2
    between = spread - mean * (1 - mean) * max(hosts - 1, 0) / docs
    strength = mean * (1 - mean) / between - 1 if between > 0 else 1e4
    strength = min(max(strength, 2.0), 1e4)
    return mean * strength, (1 - mean) * strength


def judge_quality(documents: DataFrame, host: str = "source") -> DataFrame:
    """Counts and verdict of each document: kept if it passes the base rules and its host does.

    Null and empty texts have no words and fail. Rows without a host are judged by their
    own counts. Repeated rows count each. Other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    counts = pin(document_counts(documents, host), "quality")
    verdicts = pin(host_rates(counts).select("host", "host_rejected"), "verdicts")
    counts = counts.withColumn("base_failed", failures()["base"])
    named = counts.where(F.col("host").isNotNull()).join(verdicts, "host", "left")
    rest = counts.where(F.col("host").isNull()).withColumn("host_rejected", F.lit(False))
    both = named.select(*rest.columns).unionByName(rest)
    return both.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_rejected")
    )


def keep_good(documents: DataFrame, host: str = "source") -> DataFrame:
    """The documents that :func:`judge_quality` keeps, with their columns.

    The verdict on a row depends on its text and host alone, so texts are counted where
    they lie and never shuffled. Null and empty texts have no words and go; long ones are
    counted whole; repeated rows stay or go together; a null host is a host of its own; all
    columns are kept; an empty table stays empty.
    """
    verdicts = pin(
        host_rates(document_counts(documents, host)).select(F.col("host").alias("_host"), "host_rejected"),
        "verdicts",
    )
    marked = documents.select(
        F.struct("*").alias("_row"),
        F.col("text").cast("string").alias("text"),
        F.col(host).cast("string").alias("_host"),
    )
    schema = f"_row {documents.schema.simpleString()}, _host string, " + ", ".join(f"{c} long" for c in COUNTS)
    passed = mapped(marked, _with_counts, schema).where(~failures()["base"]).select("_row", "_host")
    bad = verdicts.where("host_rejected").select("_host")
    return passed.join(bad, "_host", "left_anti").select("_row.*")
