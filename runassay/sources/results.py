"""Result table: typed read, replay-safe writes, run layout."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions.text import clean_text
from runassay.scale import line_of, pin
from runassay.sources.records import cells, scan_records, widest

# Columns a sheet may lack, with what then stands in for them.
OPTIONAL = {"timeout_states": "No", "crash": "No", "evaluation": ""}
ABSENT_AS_NULL = ["reference_link", "document_contain"]
#: Labels of a run that lie in one folder of a merged table.
SLICE_LABELS = 100_000
REQUIRED = [
    "language_status", "tester_expectation", "completion_time",
    "input_language", "output_language", "answer",
]


def normalise_results(raw: DataFrame) -> DataFrame:
    """Sheet headings to column names, missing columns filled, "no value" texts to null."""
    for heading, name in S.RESULT_HEADINGS.items():
        if heading in raw.columns and heading != name:
            raw = raw.withColumnRenamed(heading, name)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"result table lacks columns: {', '.join(missing)}")
    texts = {
        c: F.when(F.col(c).isin(S.NA_TEXTS), None).otherwise(F.col(c))
        for c in raw.columns
        if c in S.RESULT_HEADINGS.values() and c != "label"
    }
    filled = {c: F.lit(d) for c, d in OPTIONAL.items() if c not in raw.columns}
    filled |= {c: F.lit(None).cast("string") for c in ABSENT_AS_NULL if c not in raw.columns}
    return raw.withColumns(texts | filled)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Results below ``path``; ``run_date`` and ``env`` may be partition folders.

    CSV sheets are read by their own heading line each, never by a scan that infers types.
    """
    if fmt == "csv":
        raw = _read_sheets(spark, path)
    else:
        raw = spark.read.option("basePath", path).format(fmt).load(path)
    raw = normalise_results(raw)
    return raw.withColumn("label", F.col("label").cast("bigint"))


def _read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all CSV sheets by heading, whatever the order and number of their columns.

    Records are read by many tasks. A file's first record is its heading (one short row per
    file), found first; rows then meet it as they are read and pick their cells by name. A
    column that a sheet lacks gets its stand-in; a sheet without a required one is an error.
    """
    rows, leading, most = scan_records(spark, path, folders=True)
    runs = [c for c in rows.columns if c not in ("file", "block", "at", "text")]
    place = F.struct("block", "at")
    first = leading.groupBy("file", "block").agg(F.min("at").alias("at")).groupBy(F.col("file").alias("_file")).agg(F.min(place).alias("_first"))
    heads = pin(leading.join(first, (F.col("file") == F.col("_file")) & (place == F.col("_first"))).select("_file", "_first", "text"), "sheet-headings")
    # Cells are found by their heading, so none behind the widest heading is needed, however many commas texts have.
    width = widest(heads)
    heads = pin(heads.select("_file", "_first", cells(F.col("text"), width).alias("_head")), "sheet-headings")
    wanted = S.RESULT_HEADINGS
    lacking = heads.select(
        F.explode(F.array_except(F.array(*[F.lit(h) for h, c in wanted.items() if c in REQUIRED]), "_head"))
    ).distinct().collect()  # at most as many as there are required headings
    if lacking:
        raise ValueError(f"result table lacks columns: {', '.join(sorted(r[0] for r in lacking))}")
    joined = rows.join(heads, F.col("file") == F.col("_file")).where(place != F.col("_first"))
    joined = joined.withColumn("_cells", cells(F.col("text"), width, most))

    def by_name(heading: str, name: str):
        at = F.array_position("_head", heading)
        absent = F.lit(OPTIONAL.get(name)).cast("string")
        return F.when(at > 0, F.get("_cells", (at - 1).cast("int"))).otherwise(absent).alias(heading)

    return joined.select(*runs, *[by_name(h, c) for h, c in wanted.items()])


def clean_results(results: DataFrame) -> DataFrame:
    """Text columns without the control characters a sheet cannot hold."""
    texts = [f.name for f in results.schema if f.dataType.simpleString() == "string"]
    return results.withColumns({c: clean_text(c) for c in texts})


def latest_results(results: DataFrame, order: list[str]) -> DataFrame:
    """The last write per run and label.

    The winner is found on the narrow columns; whole rows are then picked by a semi-join.
    """
    keys = [*S.run_keys(results), "label"]
    winners = results.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    winners = winners.select(
        *[F.col(c).alias(f"_of_{c}") for c in keys],
        *[F.col(f"_last.{c}").alias(f"_of_{c}") for c in order],
    )
    same = F.lit(True)
    for c in (*keys, *order):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return results.join(winners, same, "left_semi").dropDuplicates([*keys, *order])


def upsert_results(batch: DataFrame, table: str, batch_id: int) -> None:
    """Land one batch; a replay of the same batch replaces its own folder only.

    Nothing already written is rewritten, however large the run it belongs to:
    ``stored_results`` lets the last write win, ``publish_results`` compacts.
    """
    clean_results(batch).write.mode("overwrite").partitionBy(*S.run_keys(batch)).parquet(
        f"{table}/batch={batch_id}"
    )


def stored_results(spark: SparkSession, table: str, order: list[str]) -> DataFrame:
    """Landed batches with the last write per run and label."""
    landed = _typed_runs(spark.read.option("basePath", table).parquet(f"{table}/batch=*"))
    return latest_results(landed, [*order, "batch"]).drop("batch")


def merge_results(batch: DataFrame, table: str, batch_id: int, order: list[str], width: int = SLICE_LABELS) -> None:
    """Merge one batch into a table that holds each run and label once.

    Runs are cut into slices of ``width`` labels. Only the slices that the batch holds are
    read, merged by last write and replaced, so a batch costs as much as what it touches,
    however many came before; a replay, or an older batch that comes late, changes nothing
    that is newer. One writer at a time; a merge that was cut off is made good by its replay.
    """
    spark = batch.sparkSession
    keys = [*S.run_keys(batch), "slice"]
    new = clean_results(batch).withColumns({"slice": line_of("label", width), "batch": F.lit(batch_id).cast("bigint")})
    new = pin(new, "batch")
    touched = new.select(*keys).distinct().collect()  # names of the folders to replace
    if not touched:
        return
    held = merged_results(spark, table, new)
    wanted = F.lit(False)
    for row in touched:
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.lit(row[c]).cast(new.schema[c].dataType))
        wanted = wanted | same
    both = new if held is None else held.where(wanted).unionByName(new, allowMissingColumns=True)
    # Spark puts new folders in the place of old ones once all is written, so the old ones may be read until then.
    (
        latest_results(both, [*order, "batch"]).hint("rebalance", *keys).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(table)
    )


def merged_results(spark: SparkSession, table: str, like: DataFrame | None = None) -> DataFrame | None:
    """The merged table, every run and label once; None if nothing has been merged yet.

    ``like`` says how columns are typed that are folders of the table.
    """
    try:
        found = spark.read.parquet(table)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if like is None:
        return _typed_runs(found)
    return found.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in like.schema if f.name in found.columns})


def _typed_runs(df: DataFrame) -> DataFrame:
    """Folder names back as what they were: a date, and texts."""
    kinds = {"run_date": "date", "env": "string", "run_id": "string", "task_set": "string"}
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in S.run_keys(df)})


def publish_results(results: DataFrame, path: str) -> None:
    """Write runs to their folders by environment, date and so on, replacing only those.

    The rebalance hint cuts a large run over several files and merges small ones.
    """
    keys = sorted(S.run_keys(results))
    (
        results.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
