"""The life of a task as keyed state: warm-up, generation, extraction, silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runassay import schema as S
from runassay.scale import ship_package
from runassay.streaming.ingest import has_key

OUT = (
    "task_key bigint, step string, state string, stable_poll bigint, stable_ts timestamp, "
    "polls bigint, reads bigint, ended_ts timestamp"
)
TASK = (
    "phase string, start_us bigint, seen_us bigint, last bigint, streak bigint, polls bigint, "
    "reads bigint, stable_poll bigint, stable_us bigint"
)
WAITING = "at_us bigint, event_id bigint, len bigint"
#: What a task is in, and the steps that rows are written at.
GENERATING, EXTRACTING, OVER = "generating", "extracting", "over"
GENERATED, ENDED = "generated", "ended"
STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of several columns needs the store that keeps them apart."""
    if spark.conf.get(STORE) != PROVIDER:
        spark.conf.set(STORE, PROVIDER)


class TaskWatch(StatefulProcessor):
    """Polls wait in list state until the watermark has passed them and are then taken in order.

    So late polls count where they belong, and what a task becomes does not depend on how its
    polls arrive. Timers wake a task for its next waiting poll, and when it has been silent too long.
    """

    def __init__(self, streak: int, warm_up: int, max_polls: int, max_reads: int, idle: int, forget: int | None):
        self.streak, self.warm_up, self.max_polls, self.max_reads = streak, 1000 * warm_up, max_polls, max_reads
        self.idle, self.forget = 1000 * idle, None if forget is None else 1000 * forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", TASK)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        task, new = self.task.get(), []
        for batch in rows:
            if task is None or task[0] != OVER:
                new += list(zip(batch["at_us"].tolist(), batch["event_id"].tolist(), batch["len"].tolist(), strict=True))
        if new:
            yield from self._advance(key, task, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        task = self.task.get()
        if task is not None and task[0] == OVER:
            self.task.clear()  # registered only where tasks are to be forgotten
        else:
            yield from self._advance(key, task, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key, task, new: list, watermark: int) -> Iterator[pd.DataFrame]:
        """Take all polls up to the watermark, in order, then see whether the task went silent.

        Every call of the store is a message, so polls that need not wait are never put there, and
        what did not change is not written again.
        """
        before, waited = task, list(self.waiting.get())
        if task is None and not waited and not new:
            return
        held = sorted(waited + new)
        due = 0
        out = []
        for at_us, _, size in held:
            at = at_us // 1000
            if at > watermark or task is not None and task[0] == OVER:
                break
            due += 1
            if task is not None and at_us - task[2] > 1000 * self.idle:
                task = self._end(key, task, task[2] + 1000 * self.idle, out, silent=True)
                break
            task = self._poll(key, task, at_us, size, out)
        if task is not None and task[0] != OVER and due == len(held) and task[2] // 1000 + self.idle < watermark:
            task = self._end(key, task, task[2] + 1000 * self.idle, out, silent=True)
        if task is not None and task != before:
            self.task.update(task)
        rest = [] if task is not None and task[0] == OVER else held[due:]
        if not due and len(rest) == len(held):
            if new:
                self.waiting.appendList(new)
        elif rest:
            self.waiting.put(rest)
        elif waited:
            self.waiting.clear()
        if task is None or task[0] != OVER:
            wake = [rest[0][0] // 1000] if rest else []
            if task is not None:
                wake.append(task[2] // 1000 + self.idle + 1)
            self.handle.registerTimer(max(min(wake), watermark + 1))
        elif self.forget is not None:
            self.handle.registerTimer(watermark + self.forget)
        if out:
            yield _rows(out)

    def _poll(self, key, task, at_us: int, size: int, out: list) -> tuple:
        """The task after one poll; times are in microseconds."""
        if task is None:
            task = (GENERATING, at_us, at_us, 0, 0, 0, 0, None, None)
        phase, start, _, last, run, polls, reads, stable_poll, stable_us = task
        if at_us - start < 1000 * self.warm_up:
            return (phase, start, at_us, *task[3:])
        if phase == GENERATING:
            run = run + 1 if size > 0 and size == last else 0
            last, polls = size, polls + 1
            if run >= self.streak:
                phase, stable_poll, stable_us = EXTRACTING, polls, at_us
            elif polls >= self.max_polls:
                phase = EXTRACTING
            task = (phase, start, at_us, last, run, polls, reads, stable_poll, stable_us)
            if phase == EXTRACTING:
                out.append(_row(key, GENERATED, S.TOTAL_TIMEOUT if stable_poll is None else "stable", task, at_us))
            return task
        task = (phase, start, at_us, last, run, polls, reads + 1, stable_poll, stable_us)
        if size > 0:
            return self._end(key, task, at_us, out, silent=False)
        return self._end(key, task, at_us, out, silent=True) if reads + 1 >= self.max_reads else task

    def _end(self, key, task, at_us: int, out: list, silent: bool) -> tuple:
        """The task is over; ``silent`` if no answer was read."""
        if task[0] == GENERATING:
            out.append(_row(key, GENERATED, S.TOTAL_TIMEOUT, task, at_us))
        states = [S.TOTAL_TIMEOUT] if task[7] is None else []
        states += [S.GENERATION_TIMEOUT] if silent else []
        out.append(_row(key, ENDED, " & ".join(states) or "No", task, at_us))
        return (OVER, *task[1:])


def _row(key, step: str, state: str, task: tuple, at_us: int) -> tuple:
    return int(key[0]), step, state, task[7], task[8], task[5], task[6], at_us


def _rows(rows: list[tuple]) -> pd.DataFrame:
    """What a task wrote; times are microseconds or None."""
    task_key, step, state, stable_poll, stable_us, polls, reads, ended_us = map(list, zip(*rows, strict=True))

    def instants(times: list) -> np.ndarray:
        return np.array([None if t is None else 1000 * t for t in times], dtype="datetime64[ns]")

    return pd.DataFrame(
        {
            "task_key": task_key, "step": step, "state": state, "stable_poll": pd.array(stable_poll, dtype="Int64"),
            "stable_ts": instants(stable_us), "polls": polls, "reads": reads, "ended_ts": instants(ended_us),
        }
    )


def _earliest(most: int, warm_up: int):
    """Of each Arrow batch, the polls of a task that can still matter.

    Polls a warm-up behind the batch's first one of a task are past its own warm-up, so
    ``most`` of them end it; of those before, the first ``most`` are enough as well.
    """

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ordered = batch.sort_values(["task_key", "at_us", "event_id"])
            first = ordered.groupby("task_key")["at_us"].transform("min")
            past = ordered["at_us"] - first >= 1_000_000 * warm_up
            yield ordered.groupby([ordered["task_key"], past]).head(most)

    return trim


def watch_tasks(
    polls: DataFrame,
    delay: str = "1 hour",
    streak: int = S.STABLE_POLLS,
    warm_up: int = S.WARM_UP_SECONDS,
    max_polls: int = S.MAX_POLLS,
    max_reads: int = S.MAX_READS,
    idle_seconds: int | None = None,
    forget_seconds: int | None = None,
) -> DataFrame:
    """Rows of tasks: ``generated`` when the answer stands still or not in time, ``ended`` at last.

    In: stream of task_key, ts, event_id, len. Polls of the first ``warm_up`` seconds do not
    count. A task generates until its length has stood still for ``streak`` polls, ``max_polls``
    at most (then a total timeout). The next polls are looks for the answer, until one finds
    text, ``max_reads`` at most (then a generation timeout). A task without polls for
    ``idle_seconds`` of event time ends there (default: what the phases allow at a poll a
    second). Polls without a key only move the watermark. The state of a task is kept, so that
    later polls are not a new one, or dropped ``forget_seconds`` of event time after its end.
    """
    spark = polls.sparkSession
    ship_package(spark)
    use_rocksdb(spark)
    idle = warm_up + max_polls + max_reads if idle_seconds is None else idle_seconds
    kept = (
        polls.withWatermark("ts", delay)
        .where(has_key("task_key", "ts"))
        .select("task_key", "ts", "event_id", "len", F.unix_micros("ts").alias("at_us"))
        .mapInPandas(
            _earliest(max_polls + max_reads, warm_up),
            "task_key bigint, ts timestamp, event_id bigint, len bigint, at_us bigint",
        )
    )
    return kept.groupBy("task_key").transformWithStateInPandas(
        TaskWatch(streak, warm_up, max_polls, max_reads, idle, forget_seconds), OUT, "Append", "EventTime"
    )
