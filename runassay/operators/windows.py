"""Stability of growing answers and consecutive closed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.scale import first_rows, number_rows

BLOCK = 100_000


def stable_at(
    polls: DataFrame,
    key: str = "task_key",
    order: tuple[str, ...] = ("ts", "event_id"),
    length: str = "len",
    streak: int = S.STABLE_POLLS,
    max_polls: int = S.MAX_POLLS,
    warm_up: int = S.WARM_UP_SECONDS,
) -> DataFrame:
    """Per task: how many polls it took until the length stood still, or a total timeout.

    Polls of a task's first ``warm_up`` seconds do not count. A poll extends the streak if
    its length is over 0 and equals the one before; the task is done at ``streak``. Only the
    first ``max_polls`` polls after the warm-up count, and map tasks drop the others before
    the shuffle. A task whose polls all fall into the warm-up is still running.
    """
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    starts = polls.groupBy(key).agg(F.min(order[0]).alias("_start")).withColumnRenamed(key, "_task")
    begun = polls.select(key, *order, length).join(starts, F.col(key) == F.col("_task"))
    counted = F.col(order[0]) >= F.col("_start") + F.expr(f"INTERVAL {int(warm_up)} SECONDS")
    seen = first_rows(begun.where(counted).select(key, *order, length), [key], list(order), max_polls, salts=16)
    same = (F.col(length) > 0) & (
        F.col(length) == F.coalesce(F.lag(length).over(w), F.lit(0))
    )
    runs = (
        seen.withColumns({"_poll": F.row_number().over(w), "_same": same})
        .withColumn("_last_break", F.max(F.when(~F.col("_same"), F.col("_poll"))).over(so_far))
        .withColumn("_streak", F.col("_poll") - F.coalesce("_last_break", F.lit(0)))
    )
    done = F.col("_streak") >= streak
    ends = (
        runs.groupBy(key)
        .agg(
            F.min(F.when(done, F.col("_poll"))).cast("bigint").alias("stable_poll"),
            F.min(F.when(done, F.col(order[0]))).alias("stable_ts"),
            F.count(F.lit(1)).alias("polls"),
        )
    )
    polls_of = F.coalesce("polls", F.lit(0))
    return (
        starts.select(F.col("_task").alias(key))
        .join(ends, key, "left")
        .withColumn("polls", polls_of)
        .withColumn(
            "state",
            F.when(F.col("stable_poll").isNotNull(), "stable")
            .when(F.col("polls") >= max_polls, S.TOTAL_TIMEOUT)
            .otherwise("running"),
        )
    )


def breaker(
    statuses: DataFrame,
    by: tuple[str, ...] = tuple(S.RUN_KEYS),
    order: tuple[str, ...] = ("ts", "event_id"),
    limit: int = S.BREAKER_LIMIT,
) -> DataFrame:
    """First moment per run at which ``limit`` windows closed in a row.

    SUCCESS and ERROR reset the count, SKIPPED and STOPPED leave it. So a trip
    is ``limit`` neighbouring closes among closes and resets. Those rows are
    numbered per run and cut into blocks that overlap by ``limit - 1`` rows,
    so that a run of any length is searched by many tasks.
    """
    by, order = list(by), list(order)
    counted = statuses.where(
        F.col("status").isin("BROWSER_CLOSED", "SUCCESS", "ERROR")
    ).select(*by, *order, (F.col("status") == "BROWSER_CLOSED").cast("int").alias("_closed"))
    numbered = number_rows(counted, by, order, name="_no", start=0)
    own = F.floor(F.col("_no") / BLOCK)
    reach = F.floor((F.col("_no") + (limit - 1)) / BLOCK)
    blocks = numbered.withColumn(
        "_block", F.explode(F.when(own == reach, F.array(own)).otherwise(F.array(own, reach)))
    )
    w = Window.partitionBy(*by, "_block").orderBy("_no")
    recent = w.rowsBetween(-(limit - 1), 0)
    trips = (
        blocks.withColumn("_sum", F.sum("_closed").over(recent))
        .groupBy(*by)
        .agg(
            F.min(
                F.when(F.col("_sum") >= limit, F.struct(*order))
            ).alias("_trip"),
            F.count_if((F.col("_closed") == 1) & (F.col("_block") == own)).alias("closes"),
        )
    )
    return trips.select(
        *by,
        "closes",
        F.col("_trip").isNotNull().alias("tripped"),
        *[F.col(f"_trip.{c}").alias(f"trip_{c}") for c in order],
    )
