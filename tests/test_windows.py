import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.operators import compare, windows
from runassay.streaming import breaker, ingest, queries, stability
from runassay.scale import scratch_dir

START = datetime.datetime(2024, 1, 1)


def expected_stability(lengths):
    """Polls come once a second, so those of the warm-up are the first five."""
    last = run = 0
    for n, size in enumerate(lengths[5:305], start=1):
        run = run + 1 if size > 0 and size == last else 0
        last = size
        if run >= 5:
            return "stable", n
    return (S.TOTAL_TIMEOUT if len(lengths) >= 305 else "running"), None


def expected_end(lengths, idle_end, reads=60):
    """Timeout states, stable poll, polls and looks of a task whose polls come once a second."""
    state, stable = expected_stability(lengths)
    polls = stable or min(len(lengths[5:]), 300)
    if state == "running":
        return (f"{S.TOTAL_TIMEOUT} & {S.GENERATION_TIMEOUT}" if idle_end else None), None, polls, 0
    late = [] if stable else [S.TOTAL_TIMEOUT]
    looks = lengths[5 + polls : 5 + polls + reads]
    found = next((i for i, size in enumerate(looks, start=1) if size > 0), None)
    if found is None and len(looks) < reads and not idle_end:
        return None, stable, polls, len(looks)
    late += [] if found else [S.GENERATION_TIMEOUT]
    return " & ".join(late) or "No", stable, polls, found or len(looks)


@pytest.fixture(scope="module")
def tasks():
    rng = random.Random(3)
    made = {k: [rng.choice((0, 1, 2)) for _ in range(rng.choice((4, 40, 200)))] for k in range(20)}
    made[90] = [i % 7 + 1 for i in range(700)]          # never stable, past the limit
    made[91] = [i % 7 + 1 for i in range(298)] + [9] * 400  # stable only after the limit
    made[92] = [0] * 50                                   # empty answers never count
    made[93] = [4, 4, 4, 4, 4, 4]
    return made


@pytest.fixture(scope="module")
def polls(spark, tasks):
    rows = [(k, START + datetime.timedelta(seconds=i), i, n) for k, v in tasks.items() for i, n in enumerate(v)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "task_key long, ts timestamp, event_id long, len long").repartition(7)


def test_stability(polls, tasks):
    got = {r.task_key: (r.state, r.stable_poll) for r in windows.stable_at(polls).collect()}
    assert got == {k: expected_stability(v) for k, v in tasks.items()}


def watched(spark, batches, **options):
    """Rows of the stream that gets ``batches`` one after another."""
    schema = "task_key long, ts timestamp, event_id long, len long"
    out, arrivals, checkpoint = (scratch_dir(spark, n) for n in ("watched", "arrivals", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        ingest.drain(queries._append(stability.watch_tasks(stream, **options), out, checkpoint))
    return spark.read.schema(stability.OUT).parquet(out).collect()


def test_streaming_stability_equals_batch(spark, polls, tasks):
    out = scratch_dir(spark, "stable")
    queries._feed(
        polls,
        lambda s, c: queries._append(stability.watch_tasks(s, delay="1 second", idle_seconds=10**8), out, c),
        close="1 day",
    )
    rows = spark.read.schema(stability.OUT).parquet(out).where("step = 'generated'").collect()
    got = {r.task_key: (r.state, r.stable_poll) for r in rows}
    assert got == {k: e for k, v in tasks.items() if (e := expected_stability(v))[0] != "running"}


@pytest.mark.parametrize("idle", [600, 10**8])
def test_three_phases_with_late_polls(spark, tasks, idle):
    """Polls arrive in any order within the delay; warm-up, generation and extraction each have their limit."""
    made = dict(tasks)
    made[94] = [5] * 11 + [0] * 59 + [3]  # the last look finds text
    made[95] = [5] * 11 + [0] * 60 + [3]  # one look too late
    made[96] = [0] * 400  # never any text
    made[97] = [7] * 4  # over within the warm-up
    rows = [(k, START + datetime.timedelta(seconds=i), i, n) for k, v in made.items() for i, n in enumerate(v)]
    rng = random.Random(1)
    # Each poll is up to 100 seconds late; the last row moves the watermark past everything.
    rows.sort(key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, 100)))
    third = len(rows) // 3
    cuts = [rows[:third], rows[third : 2 * third], [*rows[2 * third :], (None, START + datetime.timedelta(hours=5), -1, 0)]]
    got = watched(spark, cuts, delay="200 seconds", idle_seconds=idle)
    ended = {r.task_key: (r.state, r.stable_poll, r.polls, r.reads) for r in got if r.step == "ended"}
    want = {k: expected_end(v, idle_end=idle == 600) for k, v in made.items()}
    assert ended == {k: w for k, w in want.items() if w[0] is not None}
    assert len(ended) == sum(r.step == "ended" for r in got)  # one row a task
    if idle == 600:
        assert {r.task_key for r in got if r.step == "generated"} == set(made)


def test_silent_task_times_out_and_may_be_forgotten(spark):
    late = START + datetime.timedelta(hours=2)
    first = [(1, START, 1, 3), (2, START, 2, 3), (2, late, 3, 4), (None, late + datetime.timedelta(hours=1), 0, 0)]
    again = [(1, late + datetime.timedelta(hours=9), 4, 3), (None, late + datetime.timedelta(hours=20), 0, 0)]
    got = watched(spark, [first, again], delay="1 second", idle_seconds=600)
    assert sorted((r.task_key, r.step) for r in got) == [(k, s) for k in (1, 2) for s in ("ended", "generated")]
    assert {r.state for r in got if r.step == "ended"} == {f"{S.TOTAL_TIMEOUT} & {S.GENERATION_TIMEOUT}"}
    assert {r.ended_ts for r in got} == {START + datetime.timedelta(seconds=600)}
    between = [(None, late + datetime.timedelta(hours=5), 0, 0)]
    got = watched(spark, [first, between, again], delay="1 second", idle_seconds=600, forget_seconds=60)
    assert sum(r.task_key == 1 and r.step == "ended" for r in got) == 2


def test_a_waking_task_calls_the_store_few_times():
    """Each call is a message: a first look, polls that wait, and a timer that finds nothing due."""

    class Store:
        def __init__(self):
            self.calls, self.value = 0, None

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name in ("update", "put"):
                    self.value = args[0]
                elif name == "appendList":
                    self.value = (self.value or []) + args[0]
                elif name == "clear":
                    self.value = None
                return self.value is not None if name == "exists" else self.value

            return call

    class Listed(Store):
        def get(self):
            self.calls += 1
            return iter(self.value or [])

    class Times:
        at = 0

        def getCurrentWatermarkInMs(self):
            return self.at

    watch, times = stability.TaskWatch(5, 0, 300, 60, 10**6, None), Times()
    watch.task, watch.waiting, watch.handle = Store(), Listed(), Store()
    polls = pd.DataFrame({"at_us": [10**6, 2 * 10**6, 9 * 10**6], "event_id": [1, 2, 3], "len": [4, 4, 4]})

    def calls():
        made = watch.task.calls + watch.waiting.calls
        watch.task.calls = watch.waiting.calls = 0
        return made

    assert list(watch.handleInputRows((1,), iter([polls]), times)) == [] and len(watch.waiting.value) == 3
    assert calls() <= 3
    times.at = 5000
    assert list(watch.handleExpiredTimer((1,), times, None)) == [] and len(watch.waiting.value) == 1
    assert calls() <= 4
    assert list(watch.handleExpiredTimer((1,), times, None)) == [] and calls() <= 2
    assert watch.task.value[5] == 2


@pytest.mark.parametrize("block", [4, 100_000])
def test_breaker(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = random.Random(11)
    kinds = ["BROWSER_CLOSED", "SUCCESS", "ERROR", "SKIPPED", "STOPPED"]
    rows, want = [], {}
    for run in range(12):
        count = 0
        for i in range(rng.choice((3, 30, 60))):
            status = rng.choices(kinds, (4, 3, 1, 3, 1))[0]
            rows.append((run, START + datetime.timedelta(seconds=i // 2), i, status))
            count = count + 1 if status == "BROWSER_CLOSED" else 0 if status in ("SUCCESS", "ERROR") else count
            if count >= 3:
                want.setdefault(run, i)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_date int, ts timestamp, event_id long, status string")
    got = {r.run_date: r.trip_event_id for r in windows.breaker(df, by=("run_date",)).collect() if r.tripped}
    assert got == want
    closes = {r.run_date: r.closes for r in windows.breaker(df, by=("run_date",)).collect()}
    assert closes == {r: sum(1 for x in rows if x[0] == r and x[3] == kinds[0]) for r in closes}


def test_fan_out_and_unwritten(spark):
    tasks = spark.createDataFrame([(0, 1), (0, 2)], "task_set int, idx int")
    envs = spark.createDataFrame([("x", 3), ("y", 1), ("z", 2), ("q", 9)], "env string, pos int")
    assert compare.fan_out(tasks, envs).count() == 8
    planned = compare.fan_out(tasks, envs, 3)
    assert {(r.idx, r.env) for r in planned.collect()} == {(i, e) for i in (1, 2) for e in "xyz"}
    left = compare.unwritten_tasks(planned, planned.where("env <> 'x'"), ["task_set", "idx", "env"])
    assert {r.env for r in left.collect()} == {"x"}
    assert compare.fan_out(tasks, envs.limit(0)).count() == 0


def test_live_metrics_are_lazy(spark):
    stream = spark.readStream.format("rate").load().withColumn("ts", F.col("timestamp"))
    for c in ("env", "timeout_states", "crash", "language_status", "tester_expectation", "completion_time", "reference_link", "document_contain"):
        stream = stream.withColumn(c, F.lit("x"))
    assert ingest.live_metrics(stream).isStreaming


def tripped(spark, batches, **options):
    schema = "run_date date, env string, ts timestamp, event_id long, status string"
    out, arrivals, checkpoint = (scratch_dir(spark, n) for n in ("trips", "arrivals", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        ingest.drain(queries._append(breaker.first_trips(stream, **options), out, checkpoint))
    return sorted((r.env, r.trip_event_id) for r in spark.read.schema(breaker.OUT).parquet(out).collect())


def _status(second, status, env="a"):
    return (START.date(), env, START + datetime.timedelta(seconds=second), second, status)


END = (None, None, START + datetime.timedelta(days=2), None, "SUCCESS")


def test_late_reset_prevents_a_trip(spark):
    """A reset that arrives one batch late still stands between the closes."""
    closed = "BROWSER_CLOSED"
    batches = [
        [_status(0, closed), _status(10, closed), _status(30, closed)] + [_status(i, closed, "b") for i in (1, 2, 3)],
        [_status(20, "SUCCESS"), _status(9000, "SUCCESS")],
        [_status(9001, closed), _status(9002, closed), _status(9003, closed)],
        [END],
    ]
    assert tripped(spark, batches) == [("a", 9003), ("b", 3)]


@pytest.mark.parametrize("bucket,limit", [("7 seconds", 3), ("1 hour", 2)])
def test_streaming_breaker_on_shuffled_arrivals(spark, bucket, limit):
    rng = random.Random(limit)
    kinds = ["BROWSER_CLOSED", "SUCCESS", "ERROR", "SKIPPED", "STOPPED"]
    rows, want = [], {}
    for run in range(30):
        count = 0
        for i in range(rng.choice((3, 30, 60))):
            status = rng.choices(kinds, (5, 2, 1, 3, 1))[0]
            rows.append(_status(i, status, f"r{run}"))
            count = count + 1 if status == kinds[0] else 0 if status in kinds[1:3] else count
            if count >= limit:
                want.setdefault(f"r{run}", i)
    rows.sort(key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 20)))
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third], [*rows[2 * third :], END]]
    assert dict(tripped(spark, batches, limit=limit, bucket=bucket, delay="40 seconds")) == want


def test_counters_of_first_deliveries(spark):
    """A row that comes three times counts once, a window is written when it is over."""
    rows = [(START.date(), "a", i, START + datetime.timedelta(hours=i), "No", "No", "Pass", "Good", f"{i}s", "Pass", "None") for i in range(40)]
    schema = "run_date date, env string, label long, ts timestamp, crash string, timeout_states string, language_status string, " \
        "tester_expectation string, completion_time string, reference_link string, document_contain string"
    df = spark.createDataFrame(rows, schema)
    out = scratch_dir(spark, "exact")
    queries._feed(df, lambda s, c: queries._append(ingest.exact_metrics(s), out, c), repeat=3, close="5 days")
    got = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.total, r.ref_passed, r.fastest, r.slowest) for r in got] == [(24, 24, 0.0, 23.0), (16, 16, 24.0, 39.0)]


def test_unwritten_tasks_of_two_streams(spark):
    """A result in time removes its task, one too late or none leaves it; state ends with the watermark."""
    hour = datetime.timedelta(hours=1)
    planned = [(i, START + i * hour) for i in range(10)] + [(None, START + 200 * hour)]
    written = [(0, START + hour), (1, START + 4 * hour), (3, START + 3 * hour), (4, START + 4 * hour), (4, START + 4 * hour), (None, START + 200 * hour)]
    paths = scratch_dir(spark, "planned"), scratch_dir(spark, "written")
    spark.createDataFrame(planned, "label long, planned_ts timestamp").write.parquet(paths[0])
    spark.createDataFrame(written, "label long, written_ts timestamp").write.parquet(paths[1])
    streams = [spark.readStream.schema(f"label long, {c} timestamp").parquet(p) for c, p in zip(("planned_ts", "written_ts"), paths)]
    out, checkpoint = scratch_dir(spark, "unwritten"), scratch_dir(spark, "progress")
    query = queries._append(ingest.unwritten_tasks(*streams, ["label"]), out, checkpoint)
    ingest.drain(query)
    assert sorted(r.label for r in spark.read.parquet(out).collect()) == [1, 2, 5, 6, 7, 8, 9]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
