"""From test cases and captured answers to the rows of the result table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions import flags
from runassay.operators import agents, judge, matching, outcomes
from runassay.scale import pin


def prepare(
    tasks: DataFrame,
    corpus: DataFrame,
    catalog: DataFrame,
    keys: list[str],
    offered: DataFrame | None = None,
) -> DataFrame:
    """Tasks with their file, input mode, skip reason, agent, route and candidates.

    With ``offered`` (env, title), the agent is the first candidate that the task's
    environment offers; ``env`` must then be one of ``keys``.
    """
    matched = matching.skip_reason(matching.match_files(tasks, corpus, keys))
    resolved = agents.resolve_agents(matched, catalog, keys)
    if offered is None:
        return resolved
    found = agents.first_offered(
        resolved, offered, [*[c for c in resolved.columns if c not in ("env", "final_agent", "state", "agent_used")]]
    )
    return found.drop("picked")


def evaluate(
    prepared: DataFrame,
    captures: DataFrame,
    corpus: DataFrame,
    keys: list[str],
    open_backend: Callable[[], judge.Backend] | None = None,
) -> DataFrame:
    """Result rows of all tasks that ended; stopped and closed ones leave none.

    In: ``prepared`` tasks; captures (keys, answer, timeout_states, shared_link,
    prep_time, completion_time, error, stopped, and agent_used if the page told it);
    corpus (file_name, text, and path where names repeat: the least path then counts).
    Only answers that need a verdict meet their document and go to the judge. An error
    makes a row with or without an answer. Columns of ``prepared`` that name a run
    (:func:`schema.run_keys`) stay in the result.
    """
    d = S.RESULT_DEFAULTS
    run = [c for c in S.run_keys(prepared) if c not in keys]
    if "agent_used" in captures.columns:
        captures = captures.withColumnRenamed("agent_used", "_page_agent")
    else:
        captures = captures.withColumn("_page_agent", F.lit(None).cast("string"))
    ended = (
        F.col("skip_reason").isNotNull() | F.col("answer").isNotNull() | F.col("error").isNotNull()
    )
    status = outcomes.task_status(
        prepared.join(captures, keys, "left").withColumn(
            "stopped", F.coalesce("stopped", F.lit(False))
        )
    ).where(F.col("writes_row") & ended)
    crashed = F.col("status") == "ERROR"
    done = F.col("status") == "SUCCESS"
    state = F.when(done, F.col("timeout_states")).otherwise(d["timeout_states"])
    answer = F.when(done, F.col("answer"))
    rows = outcomes.after_capture(
        status.withColumns({"answer": answer, "timeout_states": state})
    )

    if open_backend is None:
        judged = judge.rule_verdict(rows).withColumnsRenamed({f: f"_{f}" for f in S.VERDICT_FIELDS})
    else:
        judged = rows.join(_asked(rows.where(done & F.col("needs_judge")), corpus, keys, open_backend),
                           keys, "left")

    skipped = F.col("status") == "SKIPPED"
    crash = F.concat(F.lit(S.CRASH_PREFIX), F.substring("error", 1, 150))
    late = done & ~F.col("needs_judge")

    def captured(column: str):
        """What the page gave; a crash keeps what had been read before it."""
        return F.when(done, F.col(column)).otherwise(
            F.coalesce(F.when(crashed, F.col(column)), F.lit(d[column]))
        )

    def chosen(field: str, failed: bool, default: str, late_text: str | None = None):
        """Fixed texts of rows that failed, the verdict of the others."""
        value = F.when(done & F.col("needs_judge"), F.col(f"_{field}"))
        if failed:
            value = F.when(skipped | crashed | late, "Failed").otherwise(value)
        if late_text:
            value = F.when(late, late_text).otherwise(value)
        return F.coalesce(value, F.lit(default))

    # What the environment offered, where that was looked up; else the resolved name.
    agent = "agent_used" if "agent_used" in prepared.columns else "final_agent"
    used = flags.or_default(agent, d["agent_used"])
    columns = {
        "label": F.col("idx") + 1,
        "request": F.col("request"),
        "filename": flags.or_default("filename", d["filename"]),
        "crash": F.when(skipped, F.col("skip_reason")).when(crashed, crash).otherwise(d["crash"]),
        "tester_expectation": chosen("tester_expectation", True, d["tester_expectation"]),
        "selected_language": flags.or_default("language", d["selected_language"]),
        "input_language": chosen("input_language", False, d["input_language"]),
        "output_language": chosen("output_language", False, d["output_language"]),
        "language_status": chosen("language_status", True, d["language_status"]),
        "answer": F.when(skipped, S.SKIP_ANSWER)
        .when(crashed, S.CRASH_ANSWER)
        .otherwise(F.col("answer")),
        "shared_link": captured("shared_link"),
        "evaluation": F.when(crashed, crash).otherwise(
            chosen("evaluation", False, d["evaluation"], S.TIMEOUT_EVALUATION)
        ),
        "agent_used": F.when(skipped, d["agent_used"])
        .when(
            crashed,
            F.coalesce(
                F.when(F.col("_page_agent") != d["agent_used"], F.col("_page_agent")),
                flags.or_default("agent", d["agent_used"]),
            ),
        )
        .otherwise(used),
        "reference_link": chosen("reference_link", False, d["reference_link"]),
        "document_contain": chosen("document_contain_citations", False, d["document_contain"]),
        "prep_time": captured("prep_time"),
        "completion_time": captured("completion_time"),
        "timeout_states": F.when(crashed, S.CRASH_TIMEOUT_STATE).otherwise(F.col("timeout_states")),
    }
    return judged.select(
        *keys, *run, *[value.alias(name) for name, value in columns.items()]
    )


def _asked(rows: DataFrame, corpus: DataFrame, keys: list[str], open_backend) -> DataFrame:
    """Verdicts of a judge, written before they are used so that no row is asked twice."""
    texts = _one_text_per_name(corpus)
    asked = rows.select(
        *keys, "request", "answer", "timeout_states", "matched_file",
        F.col("language").alias("target_language"),
    )
    # Tasks without a file share no key and so take no part in the join.
    named = asked.where(F.col("matched_file").isNotNull()).join(texts, "matched_file", "left")
    plain = asked.where(F.col("matched_file").isNull()).withColumn(
        "document", F.lit(None).cast("string")
    )
    with_documents = named.unionByName(plain).withColumn(
        "document", F.coalesce("document", F.lit(S.NO_DOCUMENT))
    )
    verdicts = judge.judge(with_documents, keys, open_backend).select(
        *keys, *[F.col(f).alias(f"_{f}") for f in S.VERDICT_FIELDS]
    )
    return pin(verdicts, "verdicts")


def _one_text_per_name(corpus: DataFrame) -> DataFrame:
    """One document per file name: that of the least path, so that no task is doubled."""
    if "path" in corpus.columns:
        least = corpus.groupBy("file_name").agg(F.min("path").alias("path"))
        corpus = corpus.join(least, ["file_name", "path"], "left_semi")
    return corpus.groupBy(F.col("file_name").alias("matched_file")).agg(
        F.min("text").alias("document")
    )
