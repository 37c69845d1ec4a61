"""Incremental result ingest, drain, duplicate suppression and live counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runassay import schema as S
from runassay.functions import flags
from runassay.functions.text import seconds
from runassay.sources.results import merge_results, upsert_results


def ingest_results(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Lands every micro-batch in its own folder; a replayed batch replaces itself."""

    def land(batch: DataFrame, batch_id: int) -> None:
        upsert_results(batch, table, batch_id)

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_stream(stream: DataFrame, table: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Merges every micro-batch into the slices of the table that it holds."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_results(batch, table, batch_id, order)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain(query: StreamingQuery) -> None:
    """Waits until everything that had arrived is written; raises what the query raised."""
    query.awaitTermination()


def without_duplicates(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First delivery per run and label within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        [*S.run_keys(stream), "label"]
    )


def has_key(key: str, ts: str) -> Column:
    """Whether a row has its key. As the test names the event time, it stays behind the watermark,
    which rows without a key may still move."""
    return F.when(F.col(ts).isNotNull(), F.col(key)).isNotNull()


def counters(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Report counters per environment and window of a stream that has its watermark."""
    t = seconds("completion_time")
    return (
        stream.groupBy(F.window("ts", width).alias("w"), "env")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(flags.is_timeout()).alias("timeouts"),
            F.count_if(flags.is_crash()).alias("crashes"),
            F.count_if(flags.is_failed()).alias("failed"),
            F.count_if(flags.is_language_failed()).alias("lang_failed"),
            F.count_if(flags.is_reference_pass()).alias("ref_passed"),
            F.count_if(flags.is_document_pass()).alias("doc_passed"),
            F.count(t).alias("timed"),
            F.min(t).alias("fastest"),
            F.max(t).alias("slowest"),
            F.avg(t).alias("mean"),
        )
        .select(F.col("w.start").alias("window_start"), "env", "total", "timeouts",
                "crashes", "failed", "lang_failed", "ref_passed", "doc_passed", "timed",
                "fastest", "slowest", "mean")
    )


def live_metrics(stream: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Report counters per environment and window, updated with every batch."""
    return counters(stream.withWatermark("ts", delay), width)


def exact_metrics(stream: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """The same counters of first deliveries, each window once it is complete.

    Duplicate suppression and counting are chained on one watermark, so a row that is
    delivered again within ``delay`` counts once. Rows without environment only move the
    watermark. For append mode.
    """
    return counters(without_duplicates(stream, delay).where(has_key("env", "ts")), width)


def unwritten_tasks(
    planned: DataFrame, results: DataFrame, on: list[str], within: str = "2 hours", delay: str = "1 hour"
) -> DataFrame:
    """Planned tasks that got no result ``within`` their time, as soon as that is certain.

    In: streams with ``planned_ts`` and ``written_ts``. Both sides leave the join's state when
    the watermark has passed the time in which they could still meet. Rows without the first
    key column only move the watermark.
    """
    plan = planned.withWatermark("planned_ts", delay).where(has_key(on[0], "planned_ts")).select(*on, "planned_ts")
    timed = F.col("written_ts").isNotNull()
    done = results.withWatermark("written_ts", delay).select(
        *[F.when(timed, F.col(c)).alias(f"_of_{c}") for c in on], "written_ts"
    )
    in_time = F.col("written_ts").between(F.col("planned_ts"), F.col("planned_ts") + F.expr(f"INTERVAL {within}"))
    same = in_time
    for c in on:
        same = same & (F.col(c) == F.col(f"_of_{c}"))
    return plan.join(done, same, "left_outer").where(F.col("written_ts").isNull()).select(*on, "planned_ts")
