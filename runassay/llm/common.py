"""Helpers shared by the operators: bounded slices of Arrow batches and safe literals."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay.scale import pin, scratch_dir, ship_package

__all__ = ["crc_fold", "mapped", "pin", "scratch_dir", "ship_package", "slices"]

#: Fixed value: a word is a run of anything but blanks and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"

ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``most`` bytes of ``column`` (one row at least).

    Work on a slice then needs memory in proportion to ``most`` and to the longest
    single text, whatever the size of the batch.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        ends = pc.cumulative_sum(
            pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
        ).to_pylist()
        first, done = 0, 0
        for i, end in enumerate(ends):
            if end - done > most and i > first:
                yield batch.slice(first, i - first)
                first, done = i, ends[i - 1]
        if first < len(ends):
            yield batch.slice(first)


def mapped(df: DataFrame, function, schema: str, *args) -> DataFrame:
    """``mapInArrow`` of ``function(batches, *args)`` with the package sent to the workers.

    Texts may be long, so the session's Arrow batches are held to ``BATCH_ROWS`` rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get(ARROW_ROWS, "10000")) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    return df.mapInArrow(functools.partial(_call, function, args), schema)


def _call(function, args, batches):
    return function(batches, *args)


def crc_fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def crc_of(key: object) -> int:
    """The same crc32 in plain Python, for tests."""
    return zlib.crc32(str(key).encode())
