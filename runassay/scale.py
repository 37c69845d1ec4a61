"""Helpers that keep one large group from landing in one task."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IDS_PER_LINE = 1000


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a single machine uses a temporary folder; a cluster must set it,
    since its executors would write to folders of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="runassay-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="runassay-code-")
    archive = shutil.make_archive(
        os.path.join(folder, "runassay"), "zip", os.path.dirname(package), "runassay"
    )
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions that stay apart however few bytes they hold.

    For costly work on small rows: adaptive execution would merge such
    partitions by size and leave the work to a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def pin(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Later steps prune its columns, and a lost executor cannot change rows
    that have already been read.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def open_files(spark: SparkSession, most: int = 200) -> Iterator[None]:
    """Writes into folders keep up to ``most`` files open a task instead of sorting rows by folder.

    A sort of whole rows spills about as much as is written. Rows of further folders are still sorted.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "row_no",
    start: int = 1,
) -> DataFrame:
    """``row_number() OVER (PARTITION BY by ORDER BY order)`` without a task per group.

    Rows are range-partitioned on (by, order), so a group of any size is cut
    over many tasks. Each task numbers its own slice; the slice sizes (one row
    per slice and group) give the offsets. The slices are pinned because both
    passes must see the same range bounds. Rows that agree in all of (by, order)
    stay in one slice, so ``order`` should end in an id.
    """
    keys = [*by, *order]
    placed = pin(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_slice", F.shiftright("_slot", 33))
    slices = placed.groupBy(*by, "_slice").agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    earlier = (
        Window.partitionBy(*by)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = slices.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_slice").alias("_by_slice"),
        (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias(
            "_shift"
        ),
    )
    same = F.col("_slice") == F.col("_by_slice")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(slices, same).select(
        *df.columns,
        (F.col("_slot") + F.col("_shift") + F.lit(start)).alias(name),
    )


def first_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int, salts: int = 0
) -> DataFrame:
    """First ``n`` rows per group; each map task already drops what is behind them.

    A large ``n`` over many map tasks still brings n rows of each to one task of a group.
    With ``salts``, a group is first cut in that many parts by a hash of ``order``.
    """
    if salts:
        salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
        parts = first_rows(df.withColumn("_salt", salt), [*by, "_salt"], order, n)
        return first_rows(parts.drop("_salt"), by, order, n)
    w = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def latest_row(
    df: DataFrame, by: Sequence[str], order: Sequence[str], first: bool = False
) -> DataFrame:
    """The row with the greatest (or least) ``order`` per key, pre-aggregated."""
    rest = [c for c in df.columns if c not in by]
    pick = F.min_by if first else F.max_by
    return (
        df.groupBy(*by)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*[F.col(c) if c in by else F.col(f"_row.{c}") for c in df.columns])
    )


def line_of(label: str, width: int = IDS_PER_LINE) -> Column:
    """The line of a list that a label belongs to."""
    return F.floor(F.col(label) / width).cast("bigint")


def id_lines(
    df: DataFrame,
    by: Sequence[str],
    label: str = "label",
    width: int = IDS_PER_LINE,
    carry: str | None = None,
) -> DataFrame:
    """Sorted, de-duplicated label lists cut into lines of at most ``width`` labels.

    Line k holds the labels of ``[k * width, (k + 1) * width)``; no line is
    dropped and none can outgrow ``width``. ``carry`` names a column whose
    value at the least label of the line comes along.
    """
    carried = [] if carry is None else [F.min_by(carry, label).alias(carry)]
    return (
        df.groupBy(*by, line_of(label, width).alias("line"))
        .agg(F.array_sort(F.collect_set(F.col(label))).alias("_ids"), *carried)
        .select(
            *by,
            "line",
            F.size("_ids").cast("bigint").alias("n"),
            F.array_join("_ids", ", ").alias("ids"),
            *([] if carry is None else [carry]),
        )
    )


def null_safe_key(key: Column, *spread: str) -> tuple[Column, Column]:
    """Join key plus a salt that spreads the rows without a key over all tasks."""
    salt = F.when(key.isNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(
        F.lit(0)
    )
    return key, salt.cast("bigint")
