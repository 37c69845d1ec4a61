"""Packing of token pieces into fixed-length sequences.

A plan needs only how many pieces there are of each length, so the driver holds a
histogram of at most ``capacity`` counts, whatever the corpus. A plan says: of the
pieces of ``length``, those ranked ``rank`` to ``rank + count`` go to the sequences
``sequence`` to ``sequence + count``, all at ``offset``. Its rows grow with the number
of distinct lengths, not with the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runassay.llm.common import mapped, pin, slices
from runassay.llm.tokens import default_vocabulary, tokenizer

CAPACITY = 2048
#: Id written behind each document.
END_ID = 0

PIECE = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "part long, part_rank long"
)


def token_pieces(
    documents: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
) -> DataFrame:
    """Cut each document's ids, with the end id, into pieces of at most ``capacity``.

    Only longer documents are cut; a null text counts as empty and has the end id alone.
    ``part`` and ``part_rank`` number the pieces of a length within a task. The result is
    written once, since both passes over it must agree.
    """
    path = vocabulary or default_vocabulary()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("part", F.spark_partition_id().cast("long"))
    return pin(mapped(docs, _pieces, PIECE, path, capacity), "pieces")


def cut_whole(ids: np.ndarray, ends: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Ids with the end id behind each text, and each piece's text, number, begin and end."""
    n = len(ends)
    last = ends + np.arange(n)  # where the end ids go
    whole = np.full(len(ids) + n, END_ID, "<u4")
    inside = np.ones(len(whole), bool)
    inside[last] = False
    whole[inside] = ids
    begins = np.concatenate([[0], last[:-1] + 1])
    lengths = last + 1 - begins
    pieces = -(-lengths // capacity)
    text = np.repeat(np.arange(n), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begins[text] + number * capacity
    return whole, text, number, start, np.minimum(start + capacity, last[text] + 1)


def _pieces(batches, path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    own = tokenizer(path)
    ranks = np.zeros(capacity + 1, np.int64)
    for batch in slices(batches):
        ids, ends = own.encode(batch.column("text"))
        whole, text, number, start, end = cut_whole(ids, ends, capacity)
        length = end - start
        data = memoryview(whole)
        crcs = [zlib.crc32(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        # Pieces of a length are numbered on from the ranks of earlier batches.
        order = np.argsort(length, kind="stable")
        run = length[order]
        rank = np.empty(len(run), np.int64)
        rank[order] = np.arange(len(run)) - np.searchsorted(run, run) + ranks[run]
        ranks += np.bincount(length, minlength=capacity + 1)
        out = {
            "doc_id": batch.column("doc_id").take(pa.array(text)),
            "piece": pa.array(number, pa.int32()),
            "start": pa.array(number * capacity, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crcs, pa.int64()),
            "part": batch.column("part").take(pa.array(text)),
            "part_rank": pa.array(rank, pa.int64()),
        }
        yield pa.RecordBatch.from_pydict(out)


class Plan:
    """Rows of a plan; pieces of a length are handed out in rank order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {v: n for v, n in counts.items() if n > 0}
        self.next = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.next[length], count, sequence, offset))
        self.next[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]


def bin_slack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Minimum bin slack over lengths with multiplicities.

    Each bin takes the longest piece left and the fullest feasible combination of the
    others: a bitset of reachable sums grows by one available length after another,
    longest first, until the gap is met or the lengths end. The combination is then
    removed, as many times at once as the counts allow.
    """
    plan = Plan(counts)
    while plan.left:
        lengths = sorted(plan.left, reverse=True)
        first = lengths[0]
        room = capacity - first
        mask = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for v in lengths:
            if v > room:
                continue
            if reach >> room & 1:
                break
            steps.append((v, reach))
            rest = min(plan.left[v] - (v == first), room // v)
            size = 1
            while rest > 0:  # 1, 2, 4, ... copies and the remainder reach every number
                take = min(size, rest)
                reach |= (reach << (v * take)) & mask
                rest -= take
                size *= 2
        total = reach.bit_length() - 1
        chosen = {first: 1}
        for v, before in reversed(steps):
            while not before >> total & 1:
                total -= v
                chosen[v] = chosen.get(v, 0) + 1
        times = min(plan.left[v] // n for v, n in chosen.items())
        offset = 0
        for v in sorted(chosen, reverse=True):
            for _ in range(chosen[v]):
                plan.place(v, times, plan.sequences, offset)
                offset += v
        plan.sequences += times
    return plan


def assigned(pieces: DataFrame, planner, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence and offset by ``planner(counts, capacity)``.

    A piece's rank among those of its length is the number in earlier parts plus its
    rank within the part; the counts of parts are one row per part and length.
    """
    local = (
        pieces.groupBy("length", "part")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = {r[0]: r[1] for r in local.groupBy("length").agg(F.sum("_n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    local = local.select(
        F.col("length").alias("_length"),
        F.col("part").alias("_part"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    plan = planner(counts, capacity)
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    ranked = (
        pieces.join(local, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
        .withColumn("_rank", F.col("_before") + F.col("part_rank"))
        .drop("_length", "_part", "_before", "part", "part_rank")
    )
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return mapped(ranked, _place, schema + ", sequence_id long, offset long", table)


def _place(batches, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (table[:, 0] << 44) + table[:, 1]
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("_rank").to_numpy()
        row = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        columns = {c: batch.column(c) for c in batch.schema.names if c != "_rank"}
        columns["sequence_id"] = pa.array(table[row, 3] + rank - table[row, 1])
        columns["offset"] = pa.array(table[row, 4])
        yield pa.RecordBatch.from_pydict(columns)


def pack_min_slack(
    documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None
) -> DataFrame:
    """One row per piece with its sequence and place, packed by minimum bin slack.

    Null and empty texts are a piece of the end id alone; repeated rows are packed each;
    a null ``doc_id`` stays null; other columns are ignored; an empty table gives no rows.
    Pieces of equal length are interchangeable and go in task order.
    """
    pieces = token_pieces(documents, capacity, vocabulary)
    return assigned(pieces, bin_slack_plan, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
