"""Streaming operators over file streams that arrive in slices of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runassay import schema as S
from runassay.plans import report as R
from runassay.plans import views as V
from runassay.plans.queries import _evaluated
from runassay.scale import scratch_dir
from runassay.sources import results as RS
from runassay.streaming import breaker, ingest, stability

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RUN = S.RUN_KEYS
SLICES = 2


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _slices(df: DataFrame, n: int, ts: str = "ts") -> list[DataFrame]:
    """``df`` cut by ``ts`` into ``n`` slices of equal duration, none of its rows left out."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    ends = [lo + (hi - lo) / n * i for i in range(1, n)]
    slices = []
    for i in range(n):
        part = df
        if i > 0:
            part = part.where(F.col(ts) > F.lit(ends[i - 1]))
        if i < n - 1:
            part = part.where(F.col(ts) <= F.lit(ends[i]))
        slices.append(part)
    return slices


def _beat(df: DataFrame, ts: str, after: str) -> DataFrame:
    """One row of nulls whose ``ts`` lies ``after`` the last one, so that all windows close."""
    last = df.agg(F.max(ts).alias(ts)).select((F.col(ts) + F.expr(f"INTERVAL {after}")).alias(ts))
    return last.select(
        *[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    )


def _feed(
    df: DataFrame,
    start: Callable[[DataFrame, str], StreamingQuery],
    slices: int = SLICES,
    repeat: int = 1,
    close: str | None = None,
) -> None:
    """Lands slice after slice and lets the query take up each one where it stopped.

    With ``close``, the last one comes with a row that much later, which ends what still waits.
    """
    spark = df.sparkSession
    arrivals, checkpoint = scratch_dir(spark, "arrivals"), scratch_dir(spark, "progress")
    parts = [part for part in _slices(df, slices) for _ in range(repeat)]
    for i, part in enumerate(parts):
        last = close is not None and i == len(parts) - 1
        (part.unionByName(_beat(df, "ts", close)) if last else part).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(df.schema).parquet(arrivals)
        ingest.drain(start(stream, checkpoint))


def _timed(df: DataFrame) -> DataFrame:
    """``ts`` as an instant, read as UTC whatever the session's time zone."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return df.withColumn("ts", F.timestamp_micros(micros))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Instants back as plain UTC timestamps."""
    epoch = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    return df.withColumns(
        {c: F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), {epoch})") for c in columns}
    )


def _append(out: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return (
        out.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _result_rows(spark, sf, **views) -> DataFrame:
    return _timed(V.results(spark, sf, labels=True, **views))


@query
def t1_ingest(spark, sf):
    """Results as they arrive, every slice delivered twice."""
    table = scratch_dir(spark, "results")
    rows = _result_rows(spark, sf).select(*RUN, "label", "ts", "event_id", "evaluation")
    _feed(rows, lambda s, c: ingest.ingest_results(s, table, c), repeat=2)
    stored = RS.stored_results(spark, table, ["ts", "event_id"])
    return stored.select(*RUN, "label", "event_id", "evaluation")


@query
def t1_merge(spark, sf):
    """Results merged as they arrive, every slice delivered twice."""
    table = scratch_dir(spark, "merged")
    rows = _result_rows(spark, sf).select(*RUN, "label", "ts", "event_id", "evaluation")
    _feed(rows, lambda s, c: ingest.merge_stream(s, table, c, ["ts", "event_id"]), repeat=2)
    return RS.merged_results(spark, table).select(*RUN, "label", "event_id", "evaluation")


@query
def t2_drain(spark, sf):
    """The report once everything that arrived is drained."""
    table = scratch_dir(spark, "results")
    rows = _result_rows(spark, sf, ratings=True)
    _feed(rows, lambda s, c: ingest.ingest_results(s, table, c))
    stored = RS.stored_results(spark, table, ["ts", "event_id"])
    return R.summary_report(stored, website="http://example.org/", generated="2024-01-31 00:00")


@query
def t3_stability(spark, sf):
    """Tasks that became stable or used up their polls."""
    out = scratch_dir(spark, "stable")
    _feed(
        _timed(V.polls(spark, sf)),
        lambda s, c: _append(stability.watch_tasks(s, idle_seconds=10**8), out, c),
        close="3 days",
    )
    rows = spark.read.schema(stability.OUT).parquet(out).where(F.col("step") == stability.GENERATED)
    return _plain(rows, "stable_ts").select("task_key", "state", "stable_poll", "stable_ts")


@query
def t4_breaker(spark, sf):
    """First trips of all runs."""
    out = scratch_dir(spark, "trips")
    statuses = _timed(V.statuses(spark, sf))
    _feed(statuses, lambda s, c: _append(breaker.first_trips(s), out, c), close="3 days")
    return _plain(spark.read.schema(breaker.OUT).parquet(out), "trip_ts")


@query
def t5_task_timeout(spark, sf):
    """How every task ended, if a day without polls ends it and errors show no text."""
    out = scratch_dir(spark, "ended")
    empty = V.table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("_empty"))
    polls = V.polls(spark, sf).join(empty, F.col("event_id") == F.col("_empty"), "left")
    polls = polls.withColumn("len", F.when(F.col("_empty").isNull(), F.col("len")).otherwise(0)).drop("_empty")
    _feed(
        _timed(polls),
        lambda s, c: _append(stability.watch_tasks(s, max_reads=3, idle_seconds=86_400), out, c),
        close="3 days",
    )
    rows = spark.read.schema(stability.OUT).parquet(out).where(F.col("step") == stability.ENDED)
    return _plain(rows, "stable_ts", "ended_ts").drop("step").withColumnRenamed("state", "timeout_states")


@query
def t6_live_metrics(spark, sf):
    """Counters per day and environment: the newest update of each."""
    table = scratch_dir(spark, "live")

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        def land(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

        return (
            ingest.live_metrics(stream).writeStream.outputMode("update").foreachBatch(land)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    _feed(_timed(V.results(spark, sf, ratings=True)), start)
    updates = spark.read.option("basePath", table).parquet(f"{table}/batch=*")
    keys = ["window_start", "env"]
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_u"))
    newest = newest.select(*keys, "_u.*").withColumn("mean", F.round("mean", 6))
    return _plain(newest, "window_start")


@query
def t7_dedupe(spark, sf):
    """Everything delivered twice, every row emitted once."""
    out = scratch_dir(spark, "once")
    rows = _result_rows(spark, sf).select(*RUN, "label", "ts", "event_id")
    _feed(
        rows, lambda s, c: _append(ingest.without_duplicates(s), out, c), slices=1, repeat=2
    )
    return spark.read.schema(rows.schema).parquet(out).select(*RUN, "label", "event_id")


@query
def t6_after_t7(spark, sf):
    """Counters of first deliveries, every slice delivered twice, each day once it is over."""
    out = scratch_dir(spark, "exact")
    rows = _timed(V.results(spark, sf, ratings=True, labels=True))
    schema = "window_start timestamp, env string, total bigint, timeouts bigint, crashes bigint, failed bigint, " \
        "lang_failed bigint, ref_passed bigint, doc_passed bigint, timed bigint, fastest double, slowest double, mean double"
    _feed(rows, lambda s, c: _append(ingest.exact_metrics(s), out, c), repeat=2, close="3 days")
    days = spark.read.schema(schema).parquet(out)
    return _plain(days.withColumn("seconds", F.round(F.col("mean") * F.col("timed"), 2)).drop("mean"), "window_start")


@query
def t8_unwritten(spark, sf):
    """Tasks whose result never came, by a join of two streams that forgets what is past."""
    written = scratch_dir(spark, "written")
    _evaluated(spark, sf).select("conv_id", "turn").write.parquet(written)
    at = "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, conv_id + turn)"
    planned = V.tasks(spark, sf).select("conv_id", "turn").withColumn("planned_ts", F.expr(at))
    results = spark.read.parquet(written).withColumn(
        "written_ts", F.expr(at + " + make_dt_interval(0, 0, 0, (conv_id * 7 + turn) % 7200)")
    )
    plans, done, out, checkpoint = (scratch_dir(spark, n) for n in ("plans", "done", "unwritten", "progress"))
    sides = [(planned, "planned_ts", plans), (results, "written_ts", done)]
    cut = [_slices(df, SLICES, ts) for df, ts, _ in sides]
    for i in range(SLICES):
        streams = []
        for (df, ts, path), parts in zip(sides, cut, strict=True):
            part = parts[i].unionByName(_beat(df, ts, "2 days")) if i == SLICES - 1 else parts[i]
            part.write.mode("append").parquet(path)
            streams.append(spark.readStream.schema(df.schema).parquet(path))
        ingest.drain(_append(ingest.unwritten_tasks(*streams, ["conv_id", "turn"]), out, checkpoint))
    return spark.read.schema("conv_id bigint, turn bigint").parquet(out)
