"""The full report as a long table; all runs and environments in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runassay import schema as S
from runassay.functions import flags
from runassay.functions.text import fixed_point, percent
from runassay.operators import insight, labels
from runassay.operators.metrics import run_metrics
from runassay.scale import IDS_PER_LINE, number_rows, pin
from runassay.sources.reports import LINE_ORDER

COLUMNS = [*LINE_ORDER, "section", "item", "value", "pct", "ids", "example"]
# What the report reads of a result; texts of questions and answers stay behind.
READ = [
    "label", "crash", "timeout_states", "tester_expectation", "language_status", "completion_time",
    "reference_link", "document_contain", "evaluation",
]

# Section titles in report order, and their item texts.
SECTIONS = {
    1: "System Login & Generation Info",
    2: "Overall Test Result Summary",
    3: "Failure Reason Breakdown",
    4: "Language Testing Summary",
    5: "Language Issue Breakdown",
    6: "Reference Testing Summary",
    7: "Performance Summary",
    8: "Crash Summary",
    9: "Timeout Summary",
    10: "Key Observations",
}
HEADINGS = {
    2: ("Item", "Count", "Percentage", None),
    3: ("Failure / Issue Type", "Count", "Percentage", "Label"),
    4: ("Status", "Count", "Percentage", None),
    5: ("Language Problem Type", "Count", "Percentage", "Label"),
    6: ("Status", "Count", "Percentage", None),
    7: ("Metric", "Result", None, None),
    8: ("Status", "Count", "Percentage", "Matching Test IDs / Detailed Reasons"),
    9: ("Status", "Count", "Percentage", "Matching Test IDs"),
    10: ("Area", "Observation", None, None),
}
EXAMPLE_HEADING = "Example"  # fifth heading of the sections with examples
SUBTITLES = {4: "Overall Language Status", 6: "Reference Output Status"}
# kind -> (section, ord) of the rows that carry label lists
LIST_PLACES = {
    "crash": (8, 4),
    "no_timeout": (9, 3),
    "timeout": (9, 4),
    "total_timeout": (9, 5),
    "gen_timeout": (9, 6),
}


# Empty rows: between the two parts of section 6, and after all sections but the last.
BLANK_ROWS = [(6, 5), *((n, 10) for n in SECTIONS if n < max(SECTIONS))]
# The rows of every run: (section, ord, item, value, count share of, list kind).
# ``value`` is a SQL expression over the run metrics; the share is value / base.
LAYOUT = [
    (2, 3, "Total Tests", "total", "total", None),
    (2, 4, "Pass", "passed", "total", None),
    (2, 5, "Failed", "failed", "total", None),
    (2, 6, "Invalid (Timeout/Crash)", "invalid", "total", None),
    (4, 3, "Pass", "lang_passed", "valid_base", None),
    (4, 4, "Failed", "lang_failed", "valid_base", None),
    (6, 3, "Pass", "ref_passed", "valid_base", None),
    (6, 4, "Failed", "ref_failed", "valid_base", None),
    (6, 8, "Pass", "doc_passed", "valid_base", None),
    (6, 9, "None", "doc_none", "valid_base", None),
    (8, 3, "No Crash", "total - crashes", "total", "none"),
    (8, 4, "Has Crash", "crashes", "total", "crash"),
    (9, 3, "No Timeout", "total - timeouts", "total", "no_timeout"),
    (9, 4, "Has Timeout (Total)", "timeouts", "total", "timeout"),
    (9, 5, " -> Total Time Exceeded", "total_timeouts", None, "total_timeout"),
    (9, 6, " -> Generation Exceeded", "gen_timeouts", None, "gen_timeout"),
]


def _quoted(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _struct(section, ord_, item, value, pct=None, ids=None, part="NULL", whole="NULL",
            kind=None, first="NULL", example=None) -> str:
    return (
        f"named_struct('section_ord', {section}, 'ord', {ord_}, 'item', {_quoted(item)}, "
        f"'value', {value}, 'pct', {_quoted(pct)}, 'ids', {_quoted(ids)}, "
        f"'part', CAST({part} AS BIGINT), 'whole', CAST({whole} AS BIGINT), "
        f"'example', {_quoted(example)}, 'kind', {_quoted(kind)}, 'first_label', CAST({first} AS BIGINT))"
    )


def _items(metrics: DataFrame, website: str, generated: str) -> DataFrame:
    """Every fixed row of the report, one inline over the run metrics."""
    rows = [_struct(n, 0, title, _quoted(None)) for n, title in SECTIONS.items()]
    rows += [_struct(n, 1, title, _quoted(None)) for n, title in SUBTITLES.items()]
    rows += [
        _struct(n, 2, a, _quoted(b), c, d, example=EXAMPLE_HEADING if n in (3, 5) else None)
        for n, (a, b, c, d) in HEADINGS.items()
    ]
    rows += [_struct(n, o, "", _quoted(None)) for n, o in BLANK_ROWS]
    rows += [
        _struct(1, 2, "Login Website", _quoted(website)),
        _struct(1, 3, "Generation Time", _quoted(generated)),
        _struct(6, 6, "Document Citation Status", _quoted(None)),
        _struct(6, 7, "Status", _quoted("Count"), "Percentage"),
        _struct(7, 3, "Fastest Response", "concat(fastest_text, 's')"),
        _struct(7, 4, "Slowest Response", "concat(slowest_text, 's')"),
        _struct(7, 5, "Average Loading Time", "concat('~', mean_text, 's')"),
    ]
    for section, ord_, item, value, base, kind in LAYOUT:
        listed = kind not in (None, "none")
        rows.append(
            _struct(
                section, ord_, item, f"CAST({value} AS STRING)",
                pct=None if base else "N/A",
                ids="None" if kind == "none" else None,
                part=value if base else "NULL",
                whole=base or "NULL",
                kind=kind if listed else None,
                first=f"{kind}_from" if listed else "NULL",
            )
        )
    zero = F.col("timed") == 0
    ready = metrics.withColumns(
        {
            "valid_base": F.greatest(F.col("valid"), F.lit(1)),
            "fastest_text": F.when(zero, "0").otherwise(F.col("fastest").cast("string")),
            "slowest_text": F.when(zero, "0").otherwise(F.col("slowest").cast("string")),
            "mean_text": fixed_point(F.col("mean"), 1),
        }
    )
    items = ready.select(*S.run_keys(metrics), F.expr(f"inline(array({', '.join(rows)}))"))
    pct = (
        F.when((F.col("item") == "Total Tests"), "100%")
        .when(F.col("whole").isNotNull(), percent("part", "whole"))
        .otherwise(F.col("pct"))
    )
    return items.withColumn("pct", pct).drop("part", "whole")


def _first_labels() -> list[Column]:
    """The least label of every listed kind: it tells which line of a list is the first."""

    def least(condition: Column, kind: str) -> Column:
        return F.min(F.when(condition, F.col("label"))).alias(f"{kind}_from")

    return [
        least(flags.is_crash(), "crash"),
        least(~flags.is_timeout(), "no_timeout"),
        least(flags.is_timeout(), "timeout"),
        least(flags.is_total_timeout(), "total_timeout"),
        least(flags.is_generation_timeout(), "gen_timeout"),
    ]


def _finish(df: DataFrame) -> DataFrame:
    titles = F.element_at(
        F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair]), F.col("section_ord")
    )
    return df.withColumn("section", titles).select(*S.run_keys(df), *COLUMNS)


def summary_report(
    results: DataFrame,
    clusters: DataFrame | None = None,
    language_clusters: DataFrame | None = None,
    observations: DataFrame | None = None,
    website: str = "",
    generated: str = "",
    notes: dict[int, DataFrame] | None = None,
) -> DataFrame:
    """All sections of all runs, ordered by (section_ord, ord, sort_key, line).

    ``clusters`` and ``language_clusters`` are long (run, issue, id); without
    the first the rules make it. ``observations`` and ``notes`` per section are
    (run, part, line, item, value).
    Label lists come in lines of bounded length: a list's first line carries
    item, count and share, further lines only labels.
    """
    results, metrics = _read_once(results)
    return _sections(results, metrics, clusters, language_clusters, observations, website, generated, notes)


def _read_once(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The narrow copy of the results that numbers, lists, crashes and rules read, and its numbers."""
    runs = S.run_keys(results)
    results = pin(results.select(*runs, *READ), "report-input")
    return results, pin(run_metrics(results, runs, *_first_labels()), "run-metrics")


def _sections(
    results: DataFrame,
    metrics: DataFrame,
    clusters: DataFrame | None,
    language_clusters: DataFrame | None,
    observations: DataFrame | None,
    website: str,
    generated: str,
    notes: dict[int, DataFrame] | None,
) -> DataFrame:
    line_no = lambda c: F.floor(F.col(c) / IDS_PER_LINE).cast("bigint")
    runs = S.run_keys(results)
    items = _items(metrics, website, generated).withColumn("sort_key", F.lit(""))
    listed = F.col("kind").isNotNull() & F.col("first_label").isNotNull()
    plain = items.where(~listed).withColumns(
        {
            "line": F.lit(0).cast("bigint"),
            "ids": F.when(F.col("kind").isNotNull(), "None").otherwise(F.col("ids")),
        }
    )
    heads = items.where(listed).select(
        *runs, "kind", line_no("first_label").alias("line"), "item", "value", "pct"
    )
    place = {k: F.lit(v[0]) for k, v in LIST_PLACES.items()}
    order = {k: F.lit(v[1]) for k, v in LIST_PLACES.items()}
    lists = (
        labels.label_lines(labels.listed_kinds(results))
        .join(heads, [*runs, "kind", "line"], "left")
        .withColumns(
            {
                "section_ord": F.element_at(
                    F.create_map(*[x for k in place for x in (F.lit(k), place[k])]), F.col("kind")
                ),
                "ord": F.element_at(
                    F.create_map(*[x for k in order for x in (F.lit(k), order[k])]), F.col("kind")
                ),
                "sort_key": F.lit(""),
                "example": F.lit(None).cast("string"),
            }
        )
    )
    crashes = labels.crash_rows(results).select(
        *runs,
        F.lit(8).alias("section_ord"), F.lit(5).alias("ord"), F.lit("").alias("sort_key"),
        F.col("label").alias("line"),
        F.concat(F.lit(" -> Test ID "), F.col("label").cast("string")).alias("item"),
        F.lit("1").alias("value"), F.lit("N/A").alias("pct"), F.col("reason").alias("ids"),
        F.lit(None).cast("string").alias("example"),
    )
    parts = [plain, lists, crashes]
    if clusters is None:
        clusters = insight.cluster_by_rules(results)
    for section, found in ((3, clusters), (5, language_clusters)):
        if found is not None:
            parts.append(_cluster_rows(found, metrics, section))
    notes = dict(notes or {})
    if observations is not None:
        notes[10] = observations
    parts += [_note_rows(said, section) for section, said in notes.items()]
    return concat_sections(*parts)


def _note_rows(notes: DataFrame, section: int) -> DataFrame:
    none = F.lit(None).cast("string")
    return notes.select(
        *S.run_keys(notes), F.lit(section).alias("section_ord"), F.lit(4).alias("ord"),
        F.lpad(F.col("part").cast("string"), 12, "0").alias("sort_key"),
        F.col("line").cast("bigint").alias("line"),
        "item", "value", none.alias("pct"), none.alias("ids"), none.alias("example"),
    )


def _cluster_rows(clusters: DataFrame, metrics: DataFrame, section: int) -> DataFrame:
    """Label lines per issue; the counts come from the lines, not from another scan."""
    lines = labels.cluster_lines(clusters)
    runs = S.run_keys(metrics)
    issues = lines.groupBy(*runs, "issue").agg(
        F.min("line").alias("_first"), F.sum("n").alias("_n")
    )
    totals = metrics.select(*runs, "total")
    counted = lines.join(issues.join(totals, runs), [*runs, "issue"])
    head = F.col("line") == F.col("_first")
    return counted.withColumns(
        {
            "item": F.when(head, F.col("issue")),
            "value": F.when(head, F.col("_n").cast("string")),
            "pct": F.when(head, percent("_n", "total")),
            "example": F.when(head, F.col("example") if "example" in lines.columns else None),
            "section_ord": F.lit(section),
            "ord": F.lit(3),
            "sort_key": F.col("issue"),
        }
    )


def insight_report(
    results: DataFrame,
    open_backend: Callable[[], Callable[[str, list[str]], str]],
    website: str = "",
    generated: str = "",
) -> DataFrame:
    """The report with issues, language problems and observations from a model.

    Evaluations and language failures all go out, in parts of bounded size, and the lists of a
    run's parts are merged into one. The observations are asked for once the issues are
    counted, and asked for again of themselves until they are one set. Replies are written
    before they are read, so no step calls the model again.
    """
    evaluations = _replies(insight.evaluable(results), open_backend, "evaluations", 1)
    languages = _replies(
        insight.language_samples(results, n=None, chars=None), open_backend, "languages", 2
    )
    clusters, problems = (pin(insight.merge_issues(x, open_backend), "merged") for x in (evaluations, languages))
    narrow, metrics = _read_once(results)
    counts = labels.cluster_counts(clusters, metrics)
    text = F.concat_ws(" ", "issue", F.concat(F.col("n").cast("string"), F.lit(" of"),
                                             F.lit(" "), F.col("total").cast("string")))
    lines = number_rows(counts, S.run_keys(results), ["n", "issue"], name="label")
    observed = _one_set(lines.withColumn("text", text), open_backend)
    return _sections(
        narrow, metrics, clusters, problems, _notes(observed), website, generated,
        notes={3: _notes(evaluations), 5: _notes(languages)},
    )


def _replies(lines: DataFrame, open_backend, topic: str, block: int) -> DataFrame:
    replies = pin(insight.ask_for_blocks(lines, open_backend, topic), topic)
    wanted = insight.blocks_of(replies).where(F.col("block") == block)
    return insight.block_rows(wanted)


def _one_set(lines: DataFrame, open_backend) -> DataFrame:
    """Observations of each run; those of several parts are observed anew, as long as they get fewer."""
    rows, before = _replies(lines, open_backend, "observations", 3), None
    runs = S.run_keys(lines)
    for _ in range(insight.MERGE_ROUNDS):
        several = pin(rows.groupBy(*runs).agg(F.max("part").alias("_parts")).where("_parts > 0").select(*runs), "parted-runs")
        notes = _notes(rows.join(several, runs, "left_semi"))
        left = notes.count()
        if not left or before is not None and left >= before:
            break
        before = left
        again = notes.withColumn("text", F.concat_ws(" ", "item", "value"))
        numbered = number_rows(again.select(*runs, "part", "line", "text"), runs, ["part", "line"], name="label").drop("part")
        newer = _replies(numbered, open_backend, "observations", 3)
        rows = rows.join(several, runs, "left_anti").select(newer.columns).unionByName(newer)
    return rows


def _notes(rows: DataFrame) -> DataFrame:
    """Rows of a block that list no tests, without the block's own title."""
    said = rows.where((F.col("kind") == "text") & (F.col("first") != F.col("name")))
    return said.select(
        *S.run_keys(said), "part", F.col("row_no").alias("line"), F.col("first").alias("item"),
        F.rtrim(F.array_join("texts", ","), F.lit(",")).alias("value"),
    )


def concat_sections(*parts: DataFrame) -> DataFrame:
    """Sections under one another; their order is in the columns, not in the rows."""
    wanted = [*S.run_keys(parts[0]), *[c for c in COLUMNS if c != "section"]]
    out = parts[0].select(*wanted)
    for part in parts[1:]:
        out = out.unionByName(part.select(*wanted))
    return _finish(out)


def environment_report(results: DataFrame, newest: bool = False, **options) -> DataFrame:
    """The full report of every run of every environment in one job, or of the ``newest`` ones."""
    if newest:
        last = results.groupBy(F.col("env").alias("_env")).agg(F.max("run_date").alias("_date"))
        same = (F.col("env") == F.col("_env")) & (F.col("run_date") == F.col("_date"))
        results = results.join(last, same, "left_semi")
    return summary_report(results, **options)
