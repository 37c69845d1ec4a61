"""Failure clusters: lines for a model, its reply blocks, and rules that need no model."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from runassay import schema as S
from runassay.functions import flags
from runassay.functions.text import (
    block,
    evaluation_line,
    is_id_cell,
    language_line,
    numbers,
    stripped,
)
from runassay.operators.judge import ATTEMPTS, attempt
from runassay.scale import first_rows, number_rows, pin, ship_package, spread

LINES_PER_CALL = 200
REPLIES_PER_BATCH = 64
#: Calls one upon another that make one list of many parts' lists.
MERGE_ROUNDS = 6

# Headings and stand-ins of the three reply blocks.
ID_HEADING = "Matching Test IDs"
BLOCKS = {
    1: ("Failure Reason Breakdown", "Failure Reason Breakdown,,,\nError,{},,"),
    2: ("Language Issue Breakdown", "Common Language Problems,,,\nProblem,Example,,\nError,{},,"),
    3: ("Key Observations", "Key Observations,,,\nArea,Observation,,\nError,{},,"),
}
PARSING_FAILED = "Parsing Failed"
API_FAILED = "API Failed"

# Issue -> pattern in the evaluation text, for runs without a model.
ISSUE_RULES = {
    "Low score": r"(?i)\bscore:? *[1-4]\b",
    "Middling score": r"(?i)\bscore:? *[5-7]\b",
    "Missing content": r"(?i)missing|incomplete|omit|遗漏|缺少",
    "Unsupported claim": r"(?i)hallucinat|fabricat|捏造|幻觉",
    "Mixed language": r"(?i)mixed language|混杂|混雜",
}


def evaluable(results: DataFrame, chars: int | None = None) -> DataFrame:
    """Rows worth clustering as labelled lines, answers whole unless ``chars`` bounds them."""
    return results.where(flags.is_evaluable()).select(
        *S.run_keys(results), "label", evaluation_line(chars=chars).alias("text")
    )


def language_samples(
    results: DataFrame, n: int | None = S.LANGUAGE_SAMPLES, chars: int | None = S.EXCERPT_CHARS
) -> DataFrame:
    """First ``n`` language failures per run (None: all) as labelled lines.

    Lines are made, and cut to ``chars`` of the answer, before the ranking moves them.
    """
    runs = S.run_keys(results)
    lines = results.where(flags.is_language_sample()).select(
        *runs, "label", language_line(chars=chars).alias("text")
    )
    return lines if n is None else first_rows(lines, runs, ["label"], n, salts=16)


def cluster_by_rules(results: DataFrame, rules: dict[str, str] = ISSUE_RULES) -> DataFrame:
    """Long (run, issue, id, example) clusters from patterns on the evaluation text."""
    hits = F.array_compact(
        F.array(*[F.when(F.col("evaluation").rlike(p), name) for name, p in rules.items()])
    )
    return results.where(flags.is_evaluable()).select(
        *S.run_keys(results), F.explode(hits).alias("issue"), F.col("label").alias("id"),
        F.translate("evaluation", "\n", " ").alias("example"),
    )


def cluster_examples(clusters: DataFrame) -> DataFrame:
    """The example of the first test of every issue."""
    return clusters.groupBy(*S.run_keys(clusters), "issue").agg(F.min_by("example", "id").alias("example"))


def ask_for_blocks(
    lines: DataFrame,
    open_backend: Callable[[], Callable[[str, list[str]], str]],
    topic: str = "evaluations",
    lines_per_call: int = LINES_PER_CALL,
    attempts: int = ATTEMPTS,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Reply per run and part: every line is sent, in parts of at most ``lines_per_call``.

    The backend gets the topic (evaluations, languages or observations) and the lines; a
    task opens one. Parts follow the label, so a run of any size becomes many small groups;
    equal names of several parts are one issue, others are merged by :func:`merge_issues`. A call that fails is tried
    again like a judge's; one that fails for good yields a null reply.
    """
    ship_package(lines.sparkSession)
    keys = [*S.run_keys(lines), "part"]
    parts = lines.withColumn("part", F.floor(F.col("label") / lines_per_call).cast("bigint"))
    # Texts are moved once and sorted once; a task reads them in order and holds those of one call.
    parts = spread(parts, *keys).sortWithinPartitions("part", *S.run_keys(lines), "label", "text").select(*keys, "text")
    schema = T.StructType([*parts.select(*keys).schema.fields, T.StructField("reply", T.StringType())])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend, fields, done = None, None, []

        def rows() -> Iterator[tuple]:
            nonlocal fields
            for batch in batches:
                fields = [*list(batch.schema)[:-1], pa.field("reply", pa.string())]
                yield from zip(*(column.to_pylist() for column in batch.columns))

        for key, told in groupby(rows(), key=lambda row: row[:-1]):
            texts = [row[-1] for row in told]

            def once(texts=texts) -> str:
                nonlocal backend
                if backend is None:
                    backend = open_backend()
                return backend(topic, list(texts))

            reply, _, error = attempt(once, _is_text, attempts, wait)
            done.append((*key, reply if error is None else None))
            if len(done) == REPLIES_PER_BATCH:
                yield _batch(done, fields)
                done = []
        if done:
            yield _batch(done, fields)

    return parts.mapInArrow(call, schema)


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))


def _is_text(reply: object) -> None:
    if not isinstance(reply, str):
        raise TypeError("no text in reply")


def blocks_of(replies: DataFrame) -> DataFrame:
    """Three block texts per reply; stand-ins say whether the call or the parsing failed."""
    ready = []
    for number, (name, stand_in) in BLOCKS.items():
        text = (
            F.when(F.col("reply").isNull(), stand_in.format(API_FAILED))
            .otherwise(F.coalesce(block("reply", number), F.lit(stand_in.format(PARSING_FAILED))))
        )
        ready.append(F.struct(F.lit(number).alias("block"), F.lit(name).alias("name"),
                              text.alias("text")))
    keys = [c for c in replies.columns if c != "reply"]
    return replies.select(*keys, F.inline(F.array(*ready)))


# One cell with the comma or line end behind it; line ends and commas may be quoted.
_CELL = r'(?:"[^"]*(?:""[^"]*)*"|[^,\n"]*)[^,\n]*[,\n]'
_ONE_CELL = re.compile(_CELL)
_CLOSED = re.compile(r'"[^"]*(?:""[^"]*)*"(?!")')
_OPENED = re.compile(r'"([^"]*(?:""[^"]*)*)"')
LINE_COLUMNS = ("line_no", "line")
# Stand-ins for quoted line ends and commas while a text is cut into rows and cells.
_HELD = "\ue000\ue001"


def _cells_by_row(text: Column) -> Column:
    """Rows of cells of a CSV text, quotes taken off."""
    plain = F.concat(F.replace(stripped(F.coalesce(text, F.lit(""))), F.lit("\r\n"), F.lit("\n")), F.lit("\n"))
    held = F.transform(
        F.regexp_extract_all(plain, F.lit(_CELL), 0),
        lambda c: F.concat(
            F.translate(F.substring(c, F.lit(1), F.char_length(c) - 1), "\n,", _HELD), F.right(c, F.lit(1))
        ),
    )
    rows = F.split(F.regexp_replace(F.array_join(held, ""), "\n$", ""), "\n")

    def bare(cell: Column) -> Column:
        inner = F.regexp_replace(cell, r'(?s)^"([^"]*(?:""[^"]*)*)"', "$1")
        inner = F.when(cell.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)
        return F.translate(inner, _HELD, "\n,")

    return F.transform(rows, lambda r: F.transform(F.split(r, ","), bare))


def block_rows(blocks: DataFrame) -> DataFrame:
    """Rows of all blocks beside the columns of ``blocks``: row_no, kind, first, ids, texts.

    A row with the id heading opens a table that the next blank row ends; so a row is in a
    table if the last heading before it comes after the last blank one. There, cells of
    digits are one list of ids, however many cells it was spread over.
    """
    rows = F.transform(
        _cells_by_row(F.col("text")),
        lambda cells, i: F.struct(
            i.alias("no"),
            cells.alias("cells"),
            (stripped(F.array_join(cells, "")) == "").alias("blank"),
            F.array_contains(cells, ID_HEADING).alias("heading"),
        ),
    )
    places = lambda kind: F.transform(F.filter("_rows", lambda r: r[kind]), lambda r: r["no"])
    marked = (
        blocks.withColumn("_rows", rows)
        .withColumns({"_heads": places("heading"), "_gaps": places("blank")})
        .withColumn("_r", F.explode("_rows"))
        .where(~F.col("_r.blank"))
    )
    no = F.col("_r.no")
    last = lambda c: F.coalesce(F.array_max(F.filter(c, lambda i: i < no)), F.lit(-1))
    return marked.select(
        *blocks.columns, no.alias("row_no"), *_told(F.col("_r.cells"), F.col("_r.heading"), last("_heads") > last("_gaps"))
    )


def _told(cells: Column, heading: Column, in_table: Column) -> list[Column]:
    """``kind, first, ids, texts`` of one row."""
    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    is_ids = lambda c: is_id_cell(c) & (stripped(c) != "")
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(rest, is_ids), numbers))))
    listed = ~heading & in_table & (F.size(ids) > 0)
    kind = F.when(heading, "heading").when(listed, "ids").otherwise("text")
    return [
        kind.alias("kind"), cells[0].alias("first"), F.when(listed, ids).alias("ids"),
        F.when(listed, F.filter(rest, lambda c: ~is_ids(c))).otherwise(rest).alias("texts"),
    ]


@F.udtf
class BlockTable:
    """Rows of cells out of the lines of a block, in order; a quoted cell may go on over lines.

    Only the lines of the row at hand are kept, and whether an id heading is open.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        keys = [f for f in lines.dataType.fields if f.name not in LINE_COLUMNS]
        return AnalyzeResult(
            T.StructType(
                [*keys, T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())),
                 T.StructField("heading", T.BooleanType()), T.StructField("in_table", T.BooleanType())]
            )
        )

    def __init__(self):
        self.keys, self.held, self.row_no, self.open = None, "", 0, False

    def eval(self, row: Row):
        self.keys = tuple(row[c] for c in row.__fields__ if c not in LINE_COLUMNS)
        self.held += row["line"] + "\n"
        yield from self._rows(final=False)

    def terminate(self):
        yield from self._rows(final=True)

    def _rows(self, final: bool):
        while self.held:
            cells, at = [], 0
            while not cells or self.held[at - 1] != "\n":
                quoted = self.held[at] == '"'
                if quoted and not final and not _CLOSED.match(self.held, at):
                    return  # its end may be in a line to come
                cell = _ONE_CELL.match(self.held, at)
                if cell is None:
                    return
                text, at = cell[0][:-1], cell.end()
                cells.append(_OPENED.sub(r"\1", text, count=1).replace('""', '"') if quoted and _OPENED.match(text) else
                             text.replace('""', '"') if quoted else text)
            self.held = self.held[at:]
            blank, heading = not "".join(cells).strip(), ID_HEADING in cells
            if not blank:
                yield (*self.keys, self.row_no, cells, heading, self.open)
            self.open = not blank and (heading or self.open)
            self.row_no += 1


def block_rows_by_line(blocks: DataFrame) -> DataFrame:
    """The same as :func:`block_rows`, by a table function over the ordered lines of each block.

    No reply is held as an array of rows: its lines are a partition that is read in order.
    """
    ship_package(blocks.sparkSession)
    keys = [c for c in blocks.columns if c != "text"]
    plain = F.replace(stripped(F.coalesce("text", F.lit(""))), F.lit("\r\n"), F.lit("\n"))
    lines = blocks.select(*keys, F.posexplode(F.split(plain, "\n")).alias(*LINE_COLUMNS))
    rows = BlockTable(spread(lines, *keys).asTable().partitionBy(*keys).orderBy(LINE_COLUMNS[0]))
    return rows.select(*keys, "row_no", *_told(F.col("cells"), F.col("heading"), F.col("in_table")))


def cluster_ids(rows: DataFrame) -> DataFrame:
    """Long (run, issue, id, example) clusters out of parsed blocks."""
    return rows.where(F.col("kind") == "ids").select(
        *S.run_keys(rows), F.col("first").alias("issue"), F.explode("ids").alias("id"),
        F.array_join("texts", ",").alias("example"),
    )


def issue_line() -> Column:
    """What a model is told of an issue when lists are merged."""
    return F.concat(
        F.lit("[Issue: "), F.col("label").cast("string"), F.lit("] "), F.col("issue"), F.lit(" | Tests: "),
        F.col("n").cast("string"), F.lit(" | Example: "), F.coalesce("example", F.lit("")),
    )


def merge_issues(
    rows: DataFrame,
    open_backend: Callable[[], Callable[[str, list[str]], str]],
    lines_per_call: int = LINES_PER_CALL,
    rounds: int = MERGE_ROUNDS,
) -> DataFrame:
    """One list of issues for each run whose lines went out in several parts.

    In: parsed rows with ``part``. Out: (run, issue, id, example) clusters as of
    :func:`cluster_ids`. The names of all parts are numbered and sent, ``lines_per_call`` at
    a time, with the topic ``merge``; the reply is a table of merged names and the numbers they
    stand for. Rounds go on until a run's names fit one call or no round makes them fewer.
    Only names pass through the model: every id is kept, and a name that a reply leaves out
    stays as it is. Names that differ from each other meet at last because the names of a
    round are sorted anew. Runs of one part are left as they are.
    """
    runs = S.run_keys(rows)
    hits = pin(
        rows.where(F.col("kind") == "ids").select(
            *runs, "part", F.col("first").alias("issue"), F.explode("ids").alias("id"), F.array_join("texts", ",").alias("example")
        ),
        "issue-ids",
    )
    several = hits.groupBy(*runs).agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a < _b").select(*runs)
    names = (
        hits.join(pin(several, "parted-runs"), runs, "left_semi").groupBy(*runs, F.col("issue").alias("_was"))
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("example", "id").alias("example"))
        .withColumn("issue", F.col("_was"))
    )
    names = pin(names, "issues")
    before = None
    for _ in range(rounds):
        now = names.groupBy(*runs, "issue").agg(F.sum("n").alias("n"), F.min("example").alias("example"))
        numbered = pin(number_rows(now, runs, ["issue"], name="label"), "numbered-issues")
        sizes = numbered.groupBy(*runs).agg(F.max("label").alias("most")).agg(F.max("most"), F.sum("most")).first()
        if sizes[0] is None or sizes[0] < 2 or before is not None and sizes[1] >= before:
            break
        replies = ask_for_blocks(numbered.withColumn("text", issue_line()), open_backend, "merge", lines_per_call)
        said = block_rows(blocks_of(pin(replies, "merges")).where(F.col("block") == 1))
        said = said.where(F.col("kind") == "ids").select(*runs, F.col("first").alias("_to"), F.explode("ids").alias("label"))
        said = said.groupBy(*runs, "label").agg(F.min("_to").alias("_to"))
        changed = numbered.select(*runs, "issue", "label").join(said, [*runs, "label"]).drop("label")
        names = names.join(changed, [*runs, "issue"], "left").withColumn("issue", F.coalesce("_to", "issue")).drop("_to")
        names, before = pin(names, "issues"), sizes[1]
        if sizes[0] < lines_per_call:
            break
    known = names.select(*runs, "_was", F.col("issue").alias("_now"))
    merged = hits.withColumnRenamed("issue", "_was").join(known, [*runs, "_was"], "left")
    return merged.select(*runs, F.coalesce("_now", "_was").alias("issue"), "id", "example").dropDuplicates([*runs, "issue", "id"])
