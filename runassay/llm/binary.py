"""Packed id matrices with cumulative segment lengths and position resets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runassay.llm.common import mapped, slices
from runassay.llm.packing import CAPACITY, Plan, cut_whole
from runassay.llm.tokens import default_vocabulary, tokenizer

#: Id in the unused end of a row.
PAD_ID = 0

ROW = (
    "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, starts array<long>"
)


ARROW_ROW = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("input_ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
    ]
)
#: Tokens that a task holds and packs together.
BLOCK_TOKENS = 8 << 20


class RoomTree:
    """Segment tree over residual room 0..capacity that finds the least room that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += bins
            at //= 2

    def least(self, room: int) -> int | None:
        """The smallest residual >= ``room`` that has an open bin."""
        at = room + self.size
        if self.open[at]:
            return room
        while at > 1:  # up to the first right-hand neighbour with a bin, then down
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit decreasing over lengths with multiplicities.

    Pieces go, longest first, to the bin with the least room that suffices. Equal pieces
    fill one such bin as far as they go before the next one, so bins in the same state are
    worked on as ranges of numbers, and the work does not grow with the pieces.
    """
    plan = Plan(counts)
    tree = RoomTree(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, bins: int) -> None:
        ranges.setdefault(room, []).append((first, bins))
        tree.add(room, bins)

    for v in sorted(plan.left, reverse=True):
        while left := plan.left.get(v, 0):
            room = tree.least(v)
            each = (capacity if room is None else room) // v
            if room is None:
                room, first, bins = capacity, plan.sequences, max(1, left // each)
                plan.sequences += bins
            else:
                first, bins = ranges[room].pop()
                tree.add(room, -bins)
            full = min(bins, left // each)
            for j in range(each if full else 0):
                plan.place(v, full, first, capacity - room + j * v)
            if full:
                put(room - each * v, first, full)
            rest = plan.left.get(v, 0)
            if full < bins and rest:
                rest = min(rest, each)
                for j in range(rest):
                    plan.place(v, 1, first + full, capacity - room + j * v)
                put(room - rest * v, first + full, 1)
                full += 1
            if full < bins:
                put(room, first + full, bins - full)
    return plan


def pack_matrices(
    documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None
) -> DataFrame:
    """Rows of packed id matrices, best fit decreasing, overlong documents split losslessly.

    Each task packs its own documents, a block of about ``BLOCK_TOKENS`` at a time, so ids
    are neither shuffled nor written before they are packed; a block leaves one row that is
    not full. ``input_ids`` holds ``capacity`` little-endian unsigned ids of 16 bits (32 for
    a larger vocabulary), unused ones ``PAD_ID``. Segment k lies between ``cu_seqlens[k]``
    and ``cu_seqlens[k + 1]``; positions restart at each of ``position_resets``; ``doc_ids``
    and ``starts`` say which part of which document it is, so the documents can be put
    together again. A null text counts as empty (end id alone), repeated rows are packed
    each, null ids stay null, other columns are ignored, an empty table gives no rows.
    """
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.spark_partition_id().cast("long").alias("part"),
    )
    return mapped(docs, _pack, ROW, vocabulary or default_vocabulary(), capacity)


def _pack(batches, path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    own = tokenizer(path)
    kind = "<u2" if own.full.get_vocab_size() <= 1 << 16 else "<u4"
    block: list[tuple[int | None, int, np.ndarray]] = []
    tokens, sequence = 0, 0
    for batch in slices(batches):
        ids, ends = own.encode(batch.column("text"))
        whole, text, number, start, end = cut_whole(ids, ends, capacity)
        whole = whole.astype(kind)
        part = batch.column("part")[0].as_py()
        docs = batch.column("doc_id").to_pylist()
        last = np.searchsorted(text, np.arange(len(docs)), side="right").tolist()
        pieces = zip(text.tolist(), (number * capacity).tolist(), start.tolist(), end.tolist(), strict=True)
        for k, (doc, own_start, a, b) in enumerate(pieces, start=1):
            block.append((docs[doc], own_start, whole[a:b]))
            tokens += b - a
            if tokens >= BLOCK_TOKENS and k == last[doc]:
                for rows in _rows(block, capacity, (part << 40) + sequence):
                    sequence += rows.num_rows
                    yield rows
                block, tokens = [], 0
    if block:
        yield from _rows(block, capacity, (part << 40) + sequence)


def _rows(block: list[tuple], capacity: int, first: int) -> Iterator[pa.RecordBatch]:
    """The block's pieces in rows, numbered from ``first``."""
    by_length: dict[int, list[tuple]] = {}
    for piece in block:
        by_length.setdefault(len(piece[2]), []).append(piece)
    plan = best_fit_plan({v: len(x) for v, x in by_length.items()}, capacity)
    places: list[list[tuple]] = [[] for _ in range(plan.sequences)]
    for length, rank, count, sequence, offset in plan.rows:
        for k in range(count):
            places[sequence + k].append((offset, by_length[length][rank + k]))
    for k in range(0, len(places), 256):
        out: dict[str, list] = {f.name: [] for f in ARROW_ROW}
        for n, parts in enumerate(places[k : k + 256], start=first + k):
            parts.sort(key=lambda p: p[0])
            used = parts[-1][0] + len(parts[-1][1][2])
            ids = np.full(capacity, PAD_ID, parts[0][1][2].dtype)
            for offset, (_, _, own) in parts:
                ids[offset : offset + len(own)] = own
            starts = [offset for offset, _ in parts]
            out["sequence_id"].append(n)
            out["n_tokens"].append(used)
            out["input_ids"].append(ids.tobytes())
            out["cu_seqlens"].append([*starts, used])
            out["position_resets"].append(starts)
            out["doc_ids"].append([doc for _, (doc, _, _) in parts])
            out["starts"].append([start for _, (_, start, _) in parts])
        yield pa.RecordBatch.from_pydict(out, ARROW_ROW)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the rows below ``path``; each file is a matrix with its segment tables."""
    packed.write.mode("overwrite").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)


def position_ids(resets: list[int], n_tokens: int) -> np.ndarray:
    """Position of each token within its segment."""
    starts = np.zeros(n_tokens, np.int64)
    starts[np.array(resets, np.int64)] = np.diff(np.array(resets), prepend=0)
    return np.arange(n_tokens) - np.cumsum(starts)
