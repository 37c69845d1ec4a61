"""Connected components of an edge table, without a driver-side or per-group structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runassay.llm.common import pin

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _to_least(edges: DataFrame, both: bool) -> DataFrame:
    """Re-hang edges (a above b) on the least neighbour of each node.

    With ``both`` the higher neighbours of a node move to its least one (large star), else
    its lower neighbours and the node itself (small star).
    """
    if both:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = sides.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of each node of ``edges (a, b)``; the component is its least node.

    Large and small stars alternate until nothing changes, which takes a number of rounds
    in the logarithm of the nodes. Every round is written to the shared folder. Edges with a
    null end or with equal ends are left out, repeated ones count once, other columns are
    ignored, and a table without edges has no nodes.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = pin(edges.select(a, b).where(F.col("a") != F.col("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        now = pin(_to_least(_to_least(now, both=True), both=False), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
