import datetime

import pytest

from pyspark.sql import functions as F

from runassay.scale import scratch_dir
from runassay.sources import corpus, records, results, sheets


def grid(spark, *cells):
    return spark.createDataFrame(cells, "path string, row_no long, col_no long, value string")


def test_header_rules(spark):
    g = grid(
        spark,
        ("a", 1, 1, "Language"), ("a", 2, 1, " REQUEST "), ("a", 2, 2, "request"), ("a", 2, 3, "lane"),
        ("a", 2, 4, "Selected Agent"), ("a", 3, 1, "filename"),
        ("b", 5, 2, "File_Name"), ("b", 5, 3, "price"), ("b", 5, 4, "目標語言"), ("b", 5, 5, "UI Lang"),
        ("c", 1, 1, "nothing"), ("c", 2, 1, "here"),
    )
    got = {r.path: tuple(r)[1:] for r in sheets.infer_header(g).select(
        "path", "row_no", "req_col", "file_col", "agent_col", "lang_col").collect()}
    assert got == {"a": (2, 2, None, 4, 3), "b": (5, None, 2, None, 5)}


def test_testcases_and_labels(spark):
    g = grid(
        spark,
        ("a", 1, 1, "Request"), ("a", 1, 2, "Filename"),
        ("a", 2, 1, " ask "), ("a", 3, 3, "only a note"), ("a", 4, 2, "x.txt"), ("a", 5, 1, "  "),
        ("a", 0, 1, "above"),
    )
    cases = sheets.assign_labels(sheets.read_testcases(g, sheets.infer_header(g)))
    got = [(r.request, r.filename, r.agent, r.idx, r.label) for r in cases.orderBy("label").collect()]
    assert got == [("ask", "", "", 0, 1), ("", "x.txt", "", 1, 2)]


def test_sheet_without_anchor_gives_no_cases(spark):
    g = grid(spark, ("a", 1, 1, "Question"), ("a", 2, 1, "x"))
    assert sheets.read_testcases(g, sheets.infer_header(g)).count() == 0


def test_csv_sheets(spark, tmp_path):
    (tmp_path / "one.csv").write_text('Notes,\nRequest,Language\n"a, ""b""\nc",EN\n,\nlast,\n', encoding="utf-8")
    (tmp_path / "two.csv").write_text("File Name\nf.pdf\n", encoding="utf-8")
    g = sheets.read_grid(spark, str(tmp_path))
    cases = sheets.assign_labels(sheets.read_testcases(g, sheets.infer_header(g)))
    got = sorted((r.path.rsplit("/", 1)[1], r.label, r.request, r.filename, r.language) for r in cases.collect())
    assert got == [
        ("one.csv", 1, 'a, "b"\nc', "", "EN"), ("one.csv", 2, "last", "", ""), ("two.csv", 1, "", "f.pdf", ""),
    ]


def test_corpus_encodings(spark, tmp_path):
    (tmp_path / "u.TXT").write_bytes("héllo\r\nworld\rend".encode())
    (tmp_path / "g.csv").write_bytes("简体中文".encode("gbk"))
    (tmp_path / "bad.txt").write_bytes(b"\x81\xff\xfe")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "x.png").write_bytes(b"png")
    got = {r.file_name: (r.base_name, r.ext, r.text) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {
        "u.TXT": ("u", ".txt", "héllo\nworld\nend"), "g.csv": ("g", ".csv", "简体中文"),
        "bad.txt": ("bad", ".txt", ""), "d.pdf": ("d", ".pdf", ""),
    }
    assert {r.file_name for r in corpus.list_corpus(spark, str(tmp_path)).collect()} == set(got)
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = corpus.list_corpus(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


RESULT = "run_date date, env string, label long, ts timestamp, evaluation string"


def result(label, hour, text, env="a"):
    return (datetime.date(2024, 1, 1), env, label, datetime.datetime(2024, 1, 1, hour), text)


def test_replayed_and_late_batches(spark):
    table = scratch_dir(spark, "results")
    first = spark.createDataFrame([result(1, 1, "old"), result(2, 1, "b\x07")], RESULT)
    results.upsert_results(first, table, 0)
    results.upsert_results(spark.createDataFrame([result(1, 3, "new"), result(1, 2, "middle")], RESULT), table, 1)
    results.upsert_results(first, table, 0)
    got = {r.label: r.evaluation for r in results.stored_results(spark, table, ["ts"]).collect()}
    assert got == {1: "new", 2: "b"}


def test_publish_replaces_only_its_runs(spark):
    path = scratch_dir(spark, "runs")
    both = spark.createDataFrame([result(1, 1, "x"), result(1, 1, "y", "b")], RESULT)
    results.publish_results(both, path)
    results.publish_results(both.where("env = 'a'").withColumn("evaluation", F.lit("z")), path)
    got = {(r.env, r.evaluation) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "z"), ("b", "y")}


def test_sheets_wider_than_usual(spark, tmp_path):
    blank = "," * 70
    (tmp_path / "wide.csv").write_text(f"{blank}Request,Language\n{blank}ask,EN\n", encoding="utf-8")
    g = sheets.read_grid(spark, str(tmp_path))
    got = sheets.read_testcases(g, sheets.infer_header(g)).collect()
    assert [(r.request, r.language) for r in got] == [("ask", "EN")]


def test_repeated_cells_do_not_fail(spark):
    g = grid(spark, ("a", 1, 1, "Request"), ("a", 2, 1, "ask"), ("a", 2, 1, "again"))
    assert [r.request for r in sheets.read_testcases(g, sheets.infer_header(g)).collect()] == ["ask"]


def test_listing_is_of_the_folder_only(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_text("y")
    assert [r.text for r in corpus.read_corpus(spark, str(tmp_path)).collect()] == ["x"]


def test_csv_sheets_are_read_by_their_own_headings(spark, tmp_path):
    head = ["label", "Language Overall Status", "Tester Expectation", "Completion Time", "Input Language", "Output Language", "answer", "Crash"]
    (tmp_path / "one.csv").write_text(",".join(head) + '\n1,Pass,Good,3s,en,en,"a, ""b""\nc",No\n', encoding="utf-8")
    (tmp_path / "two.csv").write_text("\ufeff" + ",".join(head[6::-1]) + ",Timeout_States\nans,en,fr,4s,Poor,Failed,2,yes\n", encoding="utf-8")
    got = {r.label: r for r in results.read_results(spark, str(tmp_path), fmt="csv").collect()}
    assert sorted(got) == [1, 2]
    assert (got[1].answer, got[1].crash, got[1].timeout_states) == ('a, "b"\nc', "No", "No")
    assert (got[2].answer, got[2].output_language, got[2].input_language, got[2].tester_expectation) == ("ans", "en", "fr", "Poor")
    assert (got[2].crash, got[2].timeout_states, got[2].reference_link) == ("No", "yes", None)
    (tmp_path / "three.csv").write_text("label,answer\n3,x\n", encoding="utf-8")
    with pytest.raises(ValueError, match="Completion Time"):
        results.read_results(spark, str(tmp_path), fmt="csv")


def test_texts_with_many_commas_do_not_widen_sheets(spark, tmp_path, monkeypatch):
    """Cells are parsed as far as the headings go; records of more cells than any parser's default stay whole."""
    head = ["label", "Language Overall Status", "Tester Expectation", "Completion Time", "Input Language", "Output Language", "answer"]
    text = "a,b " * 3000
    (tmp_path / "one.csv").write_text(
        ",".join(head) + f'\n1,Pass,Good,3s,en,en,"{text}"\n2,Pass,Good,3s,en,en,x{",y" * 21_000}\n', encoding="utf-8"
    )
    widths, parse = [], results.cells
    monkeypatch.setattr(results, "cells", lambda text, width, *more: widths.append(width) or parse(text, width, *more))
    got = {r.label: r.answer for r in results.read_results(spark, str(tmp_path), fmt="csv").collect()}
    assert got == {1: text, 2: "x"} and max(widths) == len(head)


def test_runs_of_one_day_stay_apart(spark):
    """Two runs and two test sets on one day, with equal labels."""
    schema = RESULT + ", run_id string, task_set string"
    rows = [(*result(1, 1, f"{run}{part}"), run, part) for run in ("r1", "r2") for part in ("s1", "s2")]
    table = scratch_dir(spark, "results")
    results.upsert_results(spark.createDataFrame(rows, schema), table, 0)
    stored = results.stored_results(spark, table, ["ts"])
    assert sorted(r.evaluation for r in stored.collect()) == ["r1s1", "r1s2", "r2s1", "r2s2"]
    path = scratch_dir(spark, "runs")
    results.publish_results(stored, path)
    results.publish_results(stored.where("run_id = 'r1'").withColumn("evaluation", F.lit("new")), path)
    assert sorted(r.evaluation for r in spark.read.parquet(path).collect()) == ["new", "new", "r2s1", "r2s2"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session(), "x")


def test_merged_batches_touch_only_their_slices(spark, tmp_path):
    """Many batches, replays and late ones: rows as by last write, untouched files as they were."""
    import os
    import random

    rng = random.Random(3)
    table, want, batches = str(tmp_path / "merged"), {}, []
    for i in range(14):
        labels = rng.sample(range(40 * (i % 4), 40 * (i % 4) + 40), 12)
        batches.append([result(n, rng.randrange(24), f"b{i}", rng.choice("ab")) for n in labels])
    batches += [batches[3], batches[0]]

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(table) for f in names if f.endswith(".parquet")}

    for i, rows in enumerate(batches):
        before = files()
        results.merge_results(spark.createDataFrame(rows, RESULT), table, i, ["ts"], width=10)
        touched = {f"env={r[1]}/slice={r[2] // 10}/" for r in rows}
        assert all(any(t in path for t in touched) for path in set(before.items()) ^ set(files().items()) for path in [path[0]])
        for day, env, label, ts, text in rows:
            if (env, label) not in want or want[env, label][0] <= ts:
                want[env, label] = (ts, text)
    got = results.merged_results(spark, table)
    assert {(r.env, r.label): (r.ts, r.evaluation) for r in got.collect()} == want and got.count() == len(want)
    assert len(files()) <= 2 * 16  # live slices, however many batches
    results.merge_results(got.limit(0).drop("slice", "batch"), table, 99, ["ts"], width=10)
    assert results.merged_results(spark, str(tmp_path / "none")) is None


def test_a_merge_writes_its_rows_once(spark, tmp_path, monkeypatch):
    """Only the batch is pinned; slices that are read are replaced by what was merged from them."""
    table, pinned, pin = str(tmp_path / "merged"), [], results.pin
    monkeypatch.setattr(results, "pin", lambda df, name: pinned.append(name) or pin(df, name))
    for i, rows in enumerate([[result(1, 1, "old"), result(2, 1, "kept")], [result(1, 2, "new")], [result(1, 1, "old")]]):
        results.merge_results(spark.createDataFrame(rows, RESULT), table, i, ["ts"])
    assert {r.label: r.evaluation for r in results.merged_results(spark, table).collect()} == {1: "new", 2: "kept"}
    assert pinned == ["batch"] * 3


def test_records_split_over_many_tasks(spark, tmp_path):
    """Quoted line ends, commas and quotes in blocks of a few bytes, against the csv module."""
    import csv
    import io
    import random

    rng = random.Random(7)
    pieces = ["a", "b,c", 'say ""x""', "two\nlines", "\n\n", "", "é", "wide " * 20, '""', "\r\nend", " , "]
    for name in ("one.csv", "two.csv"):
        rows = []
        for _ in range(400):
            cells = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 4))]
            rows.append(",".join(f'"{c}"' if any(x in c for x in '",\n\r') else c for c in cells))
        (tmp_path / name).write_bytes(("\ufeff" + "\r\n".join(rows) + "\n\n").encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, 700)
        got = records.read_records(spark, str(tmp_path))
        assert got.select("block").distinct().count() > 10
        width = records.widest(got)
        got = got.withColumn("cells", records.cells(F.col("text"), width)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name in ("one.csv", "two.csv"):
        want = [r for r in csv.reader(io.StringIO((tmp_path / name).read_bytes().decode("utf-8-sig"), newline="")) if r]
        mine = sorted((r for r in got if r.file.endswith(name)), key=lambda r: (r.block, r.at))
        mine = [[c or "" for c in r.cells] for r in mine]
        assert [r + [""] * (width - len(r)) for r in want] == mine


HEAD = ["label", "Language Overall Status", "Tester Expectation", "Completion Time", "Input Language", "Output Language", "answer"]


@pytest.fixture
def split(spark):
    """Sets how sheets are split, and how many lines come to Python at once."""
    names = {"bytes": "spark.sql.files.maxPartitionBytes", "cost": "spark.sql.files.openCostInBytes", "lines": "spark.sql.execution.arrow.maxRecordsPerBatch"}
    old = {k: spark.conf.get(k) for k in names.values()}

    def by(size, lines=10_000):
        for name, value in {"bytes": size, "cost": size, "lines": lines}.items():
            spark.conf.set(names[name], value)

    yield by
    for k, v in old.items():
        spark.conf.set(k, v)


def test_sheets_are_read_without_a_copy(spark, tmp_path, split):
    """Neither whole texts nor lines are written or shuffled, however the sheets are split."""
    import os
    import random

    rng, kept = random.Random(5), spark.conf.get("spark.checkpoint.dir")

    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(kept) for f in names if f.startswith("part-"))

    texts = ["\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200)) for _ in range(20)) for _ in range(500)]
    rows = [f'{i},Pass,Good,3s,en,en,"{t}"' for i, t in enumerate(texts)]
    (tmp_path / "one.csv").write_text("\n".join([",".join(HEAD), *rows]) + "\n", encoding="utf-8")
    for size in (128 << 20, 400_000):
        split(size)
        before = held()
        got = results.read_results(spark, str(tmp_path), fmt="csv")
        assert {r.label: r.answer for r in got.collect()} == dict(enumerate(texts))
        assert held() - before < 0.1 * os.path.getsize(tmp_path / "one.csv")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and ("Exchange hashpartitioning" not in plan or size == 400_000)  # only records of two blocks


def test_records_of_many_blocks(spark, tmp_path, split):
    """A heading of two lines, a record over whole blocks, bytes that are no UTF-8, a quote that stays open; split, packed, and in small batches."""
    import gzip

    long = "\n".join(f"line {i}, of many" for i in range(300))
    want = {1: 'a "b"', 2: long, 3: "gr\ufffd\ufffdn", 4: "open\n\nto the end,\nx"}
    head = ",".join(f'"{h}"' for h in ["label", "Notes\nof two lines", *HEAD[1:]])
    text = f'\ufeff{head}\n1,,Pass,Good,3s,en,en,"a ""b"""\r\n\r\n2,,Pass,Good,3s,en,en,"{long}"\n\n'.encode()
    text += b'3,,Pass,Good,3s,en,en,gr\xfc\xdfn\n4,,Pass,Good,3s,en,en,"open\n\nto the end,\nx'
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    (tmp_path / "plain" / "one.csv").write_bytes(text)
    (tmp_path / "packed" / "one.csv.gz").write_bytes(gzip.compress(text))
    for kind, size, lines in (("plain", 900, 10_000), ("plain", 900, 2), ("packed", 900, 3)):
        split(size, lines)
        got = results.read_results(spark, str(tmp_path / kind), fmt="csv").collect()
        assert {r.label: r.answer for r in got} == want and len(got) == 4


def test_other_blocks_than_before_are_an_error(spark, tmp_path, split):
    """Records are read anew each time, so blocks of another size must not pass as those looked at."""
    (tmp_path / "one.csv").write_text("\n".join(f'{i},"a\nb"' for i in range(400)), encoding="utf-8")
    for first, then in ((900, 700), (900, 128 << 20), (128 << 20, 900)):
        split(first)
        got = records.read_records(spark, str(tmp_path))
        assert got.count() == 400
        split(then)
        with pytest.raises(Exception, match="split other blocks"):
            got.select("text").collect()


def test_many_files_may_stay_open(spark, tmp_path):
    """Rows are written to their folders without a sort of whole rows, also if they are more than files that may be open."""
    from runassay.scale import open_files

    key, rows = "spark.sql.maxConcurrentOutputFileWriters", spark.range(1000, numPartitions=2).withColumn("part", F.col("id") % 7)
    before = spark.conf.get(key)
    for most in (3, 200):
        with open_files(spark, most):
            rows.write.partitionBy("part").parquet(str(tmp_path / str(most)))
        assert spark.conf.get(key) == before
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / str(most))).collect()) == [(i, i % 7) for i in range(1000)]
