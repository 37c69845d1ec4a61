"""Records of quoted text sheets of any size, read by many tasks."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runassay.scale import pin, ship_package

SPLITS = "spark.sql.files.minPartitionNum"
#: What a row about a block is: a first record, the part of a record that opens or goes on there, its widest record, its quotes.
FIRST, OPENS, GOES_ON, WIDEST, QUOTES = range(5)


def read_records(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """``file, block, at, text``: each record of the sheets below ``path``, lines rejoined.

    Cells may hold line ends, so a line ends a record only where the quotes before it in its
    file are even. Files are split as any text; each block of a split file counts its quotes,
    the counts of earlier blocks tell how a block begins, and only records of several blocks
    are put together. ``(file, block, at)`` is the order of records. Empty lines between
    records are no records; a byte-order mark is dropped; a quote that is never closed takes
    the rest of its file. With ``folders``, partition folders become columns.

    No text is written or shuffled but that of records of several blocks: each use of the
    records reads the sheets again.
    """
    return scan_records(spark, path, folders)[0]


def scan_records(spark: SparkSession, path: str, folders: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The records as of :func:`read_records`, the first ones and an upper bound of a record's cells.

    The first ones are few records per block, the first of each file among them.
    """
    _fix_splits(spark)
    ship_package(spark)
    reader = spark.read.option("lineSep", "\n")
    if folders:
        reader = reader.option("basePath", path)
    lines = reader.text(path)
    runs = [c for c in lines.columns if c != "value"]
    lines = lines.select(
        *runs,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("_split"),
        F.col("value").alias("text"),
    )
    fields = [*lines.select(*runs, "file", "block").schema, T.StructField("at", T.LongType()), T.StructField("text", T.StringType())]
    kinds = [T.StructField("kind", T.IntegerType()), T.StructField("cells", T.LongType())]

    def begun(odd: Column, some: DataFrame) -> DataFrame:
        # The scan's own tasks go through its lines, in their order: nothing may be dealt out between.
        return some.select(*runs, "file", "block", "length", odd.cast("long").alias("odd"), "text")

    def look(some: DataFrame) -> DataFrame:
        return pin(some.mapInArrow(functools.partial(_cut, True), T.StructType([*fields, *kinds])), "block-edges")

    edges = look(begun(F.when(~F.col("_split"), 0), lines))
    found = _widths(edges)
    blocks = None
    if QUOTES in found:
        # A row per block of split files: where it lies, and how it begins.
        counted = edges.where(F.col("kind") == QUOTES).withColumnsRenamed({"file": "_file", "block": "_block", "at": "_length"})
        before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        begins = F.coalesce(F.sum("cells").over(before), F.lit(0)) % 2
        blocks = pin(counted.select("_file", "_block", "_length", begins.alias("_odd")), "sheet-blocks")
    # Blocks other than those looked at would give records twice or not at all.
    other = F.raise_error(F.concat(F.lit("spark.sql.files.* split other blocks than before of "), F.col("file"))).cast("long")
    if blocks is None:
        odd, marked = F.when(~F.col("_split"), 0).otherwise(other), lines
    else:
        same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
        marked = lines.join(F.broadcast(blocks), same, "left")
        alone = F.col("_length").isNull() & ~F.col("_split")
        odd = F.when(alone, 0).when(F.col("_length") == F.col("length"), F.col("_odd")).otherwise(other)
        edges = edges.where(F.col("kind") != QUOTES).unionByName(look(begun(odd, marked.where("_split"))))
        found = _widths(edges)
    whole = begun(odd, marked).mapInArrow(functools.partial(_cut, False), T.StructType(fields))
    parts = [
        records.select(*runs, "file", "block", "at", _ended(F.col("text")).alias("text")).where("text <> ''")
        for records in (whole, edges.where(F.col("kind") == FIRST))
    ]
    most = found.get(WIDEST, 1)
    if OPENS in found:
        rejoined = _rejoined(edges.where(F.col("kind").isin(OPENS, GOES_ON)), runs).where("text <> ''")
        parts, most = [some.unionByName(rejoined) for some in parts], max(most, widest(rejoined))
    return parts[0], parts[1], most


def _widths(edges: DataFrame) -> dict[int, int]:
    """The kinds of edges that there are, with their most cells."""
    return {r["kind"]: r["cells"] for r in edges.groupBy("kind").agg(F.max("cells").alias("cells")).collect()}


def _fix_splits(spark: SparkSession) -> None:
    """From now on files are split the same, whatever executors come and go: both passes must see the same blocks."""
    if spark.conf.get(SPLITS, None) is None:
        leaves = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        spark.conf.set(SPLITS, leaves or spark.sparkContext.defaultParallelism)


def _ended(text: Column) -> Column:
    odd = F.startswith(text, F.lit("﻿")) | F.contains(text, F.lit("\r"))
    return F.when(odd, F.regexp_replace(text, "^﻿|\r$", "")).otherwise(text)


def _cut(edges: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of blocks, one block after another, as records, or as what is at their ``edges``."""
    block = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, text = batch.column("file"), batch.column("block"), batch.column("text")
        # As bytes, since sheets may hold what is no UTF-8.
        text = text.view(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
        turns = np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1
        for i, end in pairwise([0, *turns.tolist(), batch.num_rows]):
            place = (file[i].as_py(), start[i].as_py())
            if block is None or block.place != place:
                if block is not None:
                    yield from block.left()
                block = _Block(edges, place, batch.slice(i, 1))
            yield from block.take(text.slice(i, end - i))
    if block is not None:
        yield from block.left()


class _Block:
    """A block while its lines come in; its quotes are only counted if how it begins is unknown."""

    def __init__(self, edges: bool, place: tuple, line: pa.RecordBatch):
        self.edges, self.place = edges, place
        self.names = [c for c in line.schema.names if c not in ("length", "odd", "text")]
        self.constants = [line.column(c) for c in self.names]
        self.kind = line.column("text").type
        self.length, self.odd = line.column("length")[0].as_py(), line.column("odd")[0].as_py()
        self.goes_on = self.odd == 1  # the first line belongs to a record of an earlier block
        self.lines, self.at, self.open, self.open_cells = 0, 0, [], 1
        self.begun, self.most, self.quotes = False, 1, 0

    def take(self, text: pa.Array) -> Iterator[pa.RecordBatch]:
        """Records that end in these lines."""
        quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False)
        if self.odd is None:
            self.quotes += int(quotes.sum())
            return
        sums = self.odd + np.cumsum(quotes)
        self.odd = int(sums[-1] % 2)
        bounds = np.concatenate([[0], np.flatnonzero(sums % 2 == 0) + 1])
        n = int(bounds[-1])
        if self.edges:
            self._widest(text, bounds)
        if n and self.edges and self.begun and not self.goes_on:
            self.open = []
        elif n:
            records = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), text.slice(0, n)), b"\n")
            at = self.lines + bounds[:-1]
            if self.open or self.goes_on:
                self.open.append(records[:1])
                first = self._joined()
                if not self.goes_on:
                    yield from self._records(np.array([self.at]), first)
                elif self.edges:
                    yield self._rows(np.array([self.at]), first, GOES_ON)
                self.goes_on, records, at = False, records[1:], at[1:]
            if len(records):
                yield from self._records(at, records)
        if n:
            self.at = self.lines + n
        if n < len(text):
            self.open.append(text.slice(n))
        self.lines += len(text)

    def left(self) -> Iterator[pa.RecordBatch]:
        """What is open at the end of the block, and its widest record, or its quotes."""
        if self.odd is None:
            yield self._rows(np.array([self.length]), pa.nulls(1, self.kind), QUOTES, self.quotes)
        elif self.edges:
            if self.open:
                yield self._rows(np.array([self.at]), self._joined(), GOES_ON if self.goes_on else OPENS)
            yield self._rows(np.array([self.lines]), pa.nulls(1, self.kind), WIDEST, self.most)

    def _joined(self) -> pa.Array:
        text = b"\n".join(line for part in self.open for line in part.to_pylist())
        kind, self.open = self.open[0].type, []
        return pa.array([text], kind)

    def _widest(self, text: pa.Array, bounds: np.ndarray) -> None:
        commas = pc.count_substring(text, ",").to_numpy(zero_copy_only=False)
        n = int(bounds[-1])
        if n:
            cells = np.add.reduceat(commas[:n].astype(np.int64), bounds[:-1]) + 1
            cells[0] += self.open_cells - 1
            self.most, self.open_cells = max(self.most, int(cells.max())), 1
        self.open_cells += int(commas[n:].sum())

    def _records(self, at: np.ndarray, text: pa.Array) -> Iterator[pa.RecordBatch]:
        if not self.edges:
            yield self._rows(at, text)
        elif not self.begun:
            # Up to the first that is more than a byte-order mark and line ends.
            filled = np.flatnonzero(pc.binary_length(text).to_numpy(zero_copy_only=False))
            for n, i in enumerate(filled.tolist(), 1):
                if text[i].as_py().strip(b"\xef\xbb\xbf\r"):
                    self.begun, filled = True, filled[:n]
                    break
            if len(filled):
                yield self._rows(at[filled], text.take(pa.array(filled)), FIRST)

    def _rows(self, at: np.ndarray, text: pa.Array, kind: int | None = None, cells: int | None = None) -> pa.RecordBatch:
        same = pa.array(np.zeros(len(at), np.int64))
        columns = [*[c.take(same) for c in self.constants], pa.array(at, pa.int64()), text.view(self.kind)]
        names = [*self.names, "at", "text"]
        if kind is not None:
            columns += [pa.array([kind] * len(at), pa.int32()), pa.array([cells] * len(at), pa.int64())]
            names += ["kind", "cells"]
        return pa.RecordBatch.from_arrays(columns, names)


def _rejoined(parts: DataFrame, runs: list[str]) -> DataFrame:
    """Records of several blocks: each part belongs to the last one before it that opened one."""
    place = F.struct("block", "at")
    so_far = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.when(F.col("kind") == OPENS, place)).over(so_far)
    owners = parts.select(F.col("file").alias("_file"), place.alias("_place"), opened.alias("_record"))
    owned = parts.join(owners, (F.col("file") == F.col("_file")) & (place == F.col("_place")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda p: p["text"]), "\n")
    return owned.groupBy(*runs, "file", "_record").agg(_ended(text).alias("text")).select(
        *runs, "file", F.col("_record.block").alias("block"), F.col("_record.at").alias("at"), "text"
    )


def widest(records: DataFrame) -> int:
    """An upper bound of the cells of a record: quoted commas only make it larger."""
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    return records.agg(F.max(commas + 1)).first()[0] or 1


def cells(text: Column, width: int, most: int = 0) -> Column:
    """The record's first ``width`` cells as an array; absent and empty ones are null.

    ``most`` is a bound of the cells of a record, if some may have more than ``width``.
    """
    names = [f"c{i}" for i in range(width)]
    options = {"escape": '"', "maxColumns": str(max(20_480, width + 1, most + 1)), "maxCharsPerColumn": "-1"}
    parsed = F.from_csv(text, ", ".join(f"{n} string" for n in names), options)
    return F.transform(F.array(parsed), lambda p: F.array(*[p[n] for n in names]))[0]
