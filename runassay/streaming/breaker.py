"""Consecutive-close breaker over a stream, as sums of short times that are put in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runassay import schema as S
from runassay.scale import ship_package
from runassay.streaming.ingest import has_key
from runassay.streaming.stability import use_rocksdb

BUCKET, DELAY = "10 minutes", "1 hour"
PLACE = "struct<at:bigint,event_id:bigint>"
OUT = "run_date date, env string, trip_ts timestamp, trip_event_id bigint"


def _summary(rows: Column, limit: int) -> list[Column]:
    """What the rows of a bucket, in order, mean for the count of closes in a row.

    ``lead`` are its first closes before any reset, ``tail`` how many follow its last reset,
    ``whole`` tells that it has none, ``inner`` is the close at which ``limit`` in a row
    lie within the bucket.
    """
    closed = F.transform(rows, lambda r: r["closed"])
    lead = F.when(F.array_position(closed, 0) > 0, F.array_position(closed, 0) - 1).otherwise(F.size(rows))
    turned = F.reverse(closed)
    tail = F.when(F.array_position(turned, 0) > 0, F.array_position(turned, 0) - 1).otherwise(F.size(rows))
    start = F.struct(F.lit(0).alias("streak"), F.lit(None).cast(PLACE).alias("trip"))

    def step(a: Column, r: Column) -> Column:
        streak = F.when(r["closed"] == 1, a["streak"] + 1).otherwise(F.lit(0))
        place = F.struct(r["at"].alias("at"), r["event_id"].alias("event_id")).cast(PLACE)
        trip = F.coalesce(a["trip"], F.when(streak >= limit, place))
        return F.struct(streak.alias("streak"), trip.alias("trip"))

    places = F.transform(
        F.slice(rows, F.lit(1), F.least(lead, F.lit(limit)).cast("int")),
        lambda r: F.struct(r["at"].alias("at"), r["event_id"].alias("event_id")),
    )
    return [
        places["at"].alias("lead_at"), places["event_id"].alias("lead_id"), tail.cast("bigint").alias("tail"),
        (F.array_position(closed, 0) == 0).alias("whole"),
        F.aggregate(rows, start, step)["trip"].alias("inner"),
    ]


class RunWatch(StatefulProcessor):
    """Closes in a row at the end of the buckets seen so far; nothing else is kept of a run.

    A bucket arrives once the watermark has passed it, so all later ones are later in time.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "streak bigint, tripped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streak, tripped = self.streak.get() if self.streak.exists() else (0, False)
        found = pd.concat(list(rows)).sort_values("begin") if not tripped else pd.DataFrame()
        trip = None
        for r in found.itertuples():
            need = self.limit - streak
            if len(r.lead_at) >= need:
                trip = (int(r.lead_at[need - 1]), int(r.lead_id[need - 1]))
            elif pd.notna(r.inner_at):
                trip = (int(r.inner_at), int(r.inner_id))
            if trip is not None:
                break
            streak = streak + int(r.tail) if r.whole else int(r.tail)
        self.streak.update((streak, tripped or trip is not None))
        if trip is not None:
            yield pd.DataFrame(
                {"run_date": [key[0]], "env": [key[1]], "trip_ts": [pd.Timestamp(trip[0], unit="us")], "trip_event_id": [trip[1]]}
            )

    def close(self) -> None:
        pass


def first_trips(
    stream: DataFrame, limit: int = S.BREAKER_LIMIT, delay: str = DELAY, bucket: str = BUCKET
) -> DataFrame:
    """First moment per run at which ``limit`` windows closed in a row.

    In: stream of run_date, env, ts, event_id, status. Rows may arrive out of order by up to
    ``delay`` of event time. The rows of a run and ``bucket`` of time wait together until the
    watermark has passed it, so a run that holds a third of all rows is spread over tasks by
    its buckets; one small row per bucket then goes to the run's count. Each row is read once.
    Rows without a run only move the watermark. Other statuses than closes and resets do not count.
    """
    ship_package(stream.sparkSession)
    use_rocksdb(stream.sparkSession)
    counted = stream.withWatermark("ts", delay).where(
        F.when(has_key("env", "ts"), F.col("status")).isin("BROWSER_CLOSED", "SUCCESS", "ERROR")
    )
    row = F.struct(
        F.unix_micros("ts").alias("at"), "event_id", (F.col("status") == "BROWSER_CLOSED").cast("int").alias("closed")
    )
    buckets = (
        counted.groupBy(F.window("ts", bucket).alias("w"), *S.RUN_KEYS)
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .select(*S.RUN_KEYS, F.col("w.start").alias("begin"), *_summary(F.col("rows"), limit))
        .select(
            *S.RUN_KEYS, F.unix_micros("begin").alias("begin"), "lead_at", "lead_id", "tail", "whole",
            F.col("inner.at").alias("inner_at"), F.col("inner.event_id").alias("inner_id"),
        )
    )
    return buckets.groupBy(*S.RUN_KEYS).transformWithStateInPandas(RunWatch(limit), OUT, "Append", "None")
