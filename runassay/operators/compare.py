"""Environments side by side, fan-out of tasks, and tasks never written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay.functions import flags
from runassay.functions.text import seconds


OUTCOMES = ["crash", "timeout", "failed", "pass"]


def fan_out(tasks: DataFrame, envs: DataFrame, n: int | None = None) -> DataFrame:
    """Each task once per environment, or for the first ``n`` environments by ``pos``.

    The names are read ahead (the list of environments is a configuration) and exploded in
    place, so the tasks are neither shuffled nor joined.
    """
    first = envs.orderBy("pos") if n is None else envs.orderBy("pos").limit(n)
    names = [r.env for r in first.select("env").collect()]
    if not names:
        return tasks.withColumn("env", F.lit(None).cast("string")).where(F.lit(False))
    return tasks.withColumn("env", F.explode(F.array(*[F.lit(x) for x in names])))


def unwritten_tasks(planned: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Planned tasks whose position holds no result."""
    return planned.join(results.select(*on), on, "left_anti")


def compare_envs(results: DataFrame, env_a: str, env_b: str) -> DataFrame:
    """Both environments per run date and label: statuses, flips, time difference.

    One aggregation by (run_date, label) over one scan stands for the full
    outer join of two slices.
    """
    failed = flags.is_failed()
    # As a number, so that the aggregation keeps fixed-width buffers and hashes.
    outcome = F.when(flags.is_crash(), 1).when(flags.is_timeout(), 2).when(failed, 3).otherwise(4)
    t = seconds("completion_time")
    sides = results.where(F.col("env").isin(env_a, env_b)).select(
        "run_date", "label", "env", outcome.alias("_outcome"), t.alias("_seconds")
    )

    def of(env: str, column: str):
        return F.max(F.when(F.col("env") == env, F.col(column)))

    def name(code):
        named = F.lit(None).cast("string")
        for number, outcome in enumerate(OUTCOMES, start=1):
            named = F.when(code == number, outcome).otherwise(named)
        return named

    return (
        sides.groupBy("run_date", "label")
        .agg(
            name(of(env_a, "_outcome")).alias("outcome_a"),
            name(of(env_b, "_outcome")).alias("outcome_b"),
            of(env_a, "_seconds").alias("seconds_a"),
            of(env_b, "_seconds").alias("seconds_b"),
        )
        .withColumns(
            {
                "flipped": (F.col("outcome_a") != F.col("outcome_b")),
                "seconds_delta": F.round(F.col("seconds_b") - F.col("seconds_a"), 6),
            }
        )
    )
