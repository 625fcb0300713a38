"""Words and lines are shuffled as runs, by page: a row a word takes many times the bytes of the text."""

from pyspark.sql import functions as F

from veriloom.operators import words as traced
from veriloom.sources.shared import packed, unpacked


def test_rows_that_stand_together_are_one(spark):
    rows = [(1, "a", 3, "x"), (1, "a", 1, None), (1, "b", 2, "y"), (2, "b", 2, "z"), (None, "b", 5, "u"), (None, "b", 6, "v"), (1, "a", 9, "w")]
    df = spark.createDataFrame(rows, "k long, l string, i int, t string").coalesce(1)
    runs = packed(df, "k", "l")
    assert [tuple(r) for r in runs.collect()][:2] == [(1, "a", [3, 1], ["x", None]), (1, "b", [2], ["y"])]
    assert runs.count() == 6 and sorted(map(str, unpacked(runs, "k", "l").collect())) == sorted(map(str, df.collect()))


def test_words_are_shuffled_by_lines_of_pages(spark):
    words = spark.range(600).select(F.lit(1).cast("long").alias("label_id"), F.floor(F.col("id") / 60).cast("int").alias("line_no"), (F.col("id") % 60).cast("int").alias("word_no"), F.concat(F.lit("w"), F.col("id")).alias("text")).coalesce(1)
    wanted = spark.createDataFrame([(1, "k", 0, "w61 w62", None, None), (1, "r", 0, "other", 9, 9)], "label_id long, key string, part int, text string, line_start int, line_end int")
    found = traced.run_words(words, wanted)
    assert sorted(tuple(r)[1:] for r in found.where("key = 'k'").collect()) == [("k", 0, 1, 1, True), ("k", 0, 1, 2, True)]
    assert found.where("key = 'r' and not exact").count() == 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "RepartitionByExpression [label_id" in plan
    lines = {r.line_no: r.tokens for r in traced.lines_of_words(words).collect()}
    assert len(lines) == 10 and [t.token for t in lines[1]] == [f"w{i}" for i in range(60, 120)]


def test_a_word_of_several_tokens_and_lines_out_of_order(spark):
    rows = [(1, 1, 1, "b"), (1, 0, 2, "--"), (1, 0, 1, "x/y z"), (1, 1, 0, "a"), (1, 0, 3, "c")]
    words = spark.createDataFrame(rows, "label_id long, line_no int, word_no int, text string").coalesce(1)
    lines = {r.line_no: [(t.word_no, t.token) for t in r.tokens] for r in traced.lines_of_words(words).collect()}
    assert lines == {0: [(1, "x"), (1, "y"), (1, "z"), (3, "c")], 1: [(0, "a"), (1, "b")]}
    wanted = spark.createDataFrame([(1, "k", 0, "z c a", None, None)], "label_id long, key string, part int, text string, line_start int, line_end int")
    assert sorted(tuple(r)[3:] for r in traced.run_words(words, wanted).collect()) == [(0, 1, True), (0, 2, True), (0, 3, True), (1, 0, True)]


def test_texts_are_shuffled_once_and_lines_without_a_hyphen_not_looked_up(spark):
    from veriloom.operators import statement

    text = F.when(F.col("id") % 10 == 3, "an exam-").when(F.col("id") % 10 == 4, "ple-").when(F.col("id") % 10 == 5, "ase here").otherwise("no hyphen")
    lines = spark.range(600).select((F.col("id") / 100).cast("int").alias("doc"), (F.col("id") % 100).cast("int").alias("line_no"), text.alias("text"), (F.col("id") * 2).alias("more")).coalesce(1)
    found = statement.rejoin_hyphenated(lines, spark.createDataFrame([("example",), ("please",)], "word string").hint("merge"), "doc")
    rows = sorted(tuple(r) for r in found.collect())
    assert found.columns == lines.columns and len(rows) == 600
    assert [t for _, _, t, _ in rows[3:6]] == ["an example-", "", "ase here"] and all(m == 2 * (100 * d + i) for d, i, _, m in rows)
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("MapInArrow") == 2 and "LeftSemi" in plan.toString()
