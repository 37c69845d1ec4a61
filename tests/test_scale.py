import random

from pyspark.sql import functions as F

from runassay.scale import first_rows, id_lines, latest_row, null_safe_key, number_rows


def test_number_rows_with_one_group_holding_most(spark):
    rows = [(0 if i % 3 else i % 7, i * 7919 % 10007, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o long, id long").repartition(16)
    out = number_rows(df, ["k"], ["o", "id"], name="n")
    want, seen = {}, {}
    for k, _, i in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert {r.id: r.n for r in out.collect()} == want


def test_number_rows_keeps_null_groups_and_start(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, o int")
    got = sorted((str(r.k), r.o, r.n) for r in number_rows(df, ["k"], ["o"], "n", 0).collect())
    assert got == [("None", 1, 0), ("None", 2, 1), ("a", 5, 0)]


def test_id_lines_are_bounded_and_whole(spark):
    ids = list(range(1, 2501)) * 2
    random.Random(1).shuffle(ids)
    lines = id_lines(spark.createDataFrame([("x", i) for i in ids], "k string, label long"), ["k"])
    rows = sorted(lines.collect(), key=lambda r: r.line)
    assert [r.n for r in rows] == [999, 1000, 501]
    assert [int(x) for r in rows for x in r.ids.split(", ")] == list(range(1, 2501))


def test_latest_and_first_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in latest_row(df, ["k"], ["o"]).collect()} == {("a", "z"), ("b", None)}
    assert {(r.k, r.v) for r in latest_row(df, ["k"], ["o"], first=True).collect()} == {("a", "x"), ("b", None)}


def test_first_rows_prunes_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 2)
    top = first_rows(df, ["k"], ["id"], 3)
    assert sorted(r.id for r in top.collect()) == [0, 1, 2, 3, 4, 5]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rows_without_key_are_spread(spark):
    df = spark.range(1000).withColumn("name", F.lit(None).cast("string"))
    key, salt = null_safe_key(F.col("name"), "id")
    assert df.select(salt.alias("s")).distinct().count() > 900
    assert df.select(null_safe_key(F.lit("a"), "id")[1].alias("s")).distinct().count() == 1
