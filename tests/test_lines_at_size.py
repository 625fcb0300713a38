"""Normal forms and lines of large tables: each text is normalised once, by means that equal the Unicode patterns, and words are shuffled by runs."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from veriloom.functions import text as tx
from veriloom.operators import lines


def test_the_short_way_of_the_loose_form_equals_the_patterns(spark):
    rng = random.Random(3)
    parts = [*"ab1 2.,;:_-%/()\t\n\x00\x1c'\"", "alc", "vol.", " by ", "abv", "12", "  ", "ß", "ø", "я", "é"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(12))),) for _ in range(5000)]
    folded = F.lower(tx.fold_accents("text"))
    found = spark.createDataFrame(rows, "text string").select("text", tx._simple_bare(folded).alias("short"), tx._bare(folded).alias("wanted"), tx.normalize_loose("text").alias("loose"))
    assert found.where("not (short <=> wanted) or not (loose <=> wanted)").take(3) == []


def test_two_passes_normalise_a_line_once(spark):
    first = [(1, 0, "One, two"), (1, 1, "three."), (1, 2, "..."), (2, 0, "one two")]
    second = [(1, 0, " one two  "), (1, 1, "Four!"), (1, 2, "four"), (1, 3, "--"), (2, 0, "three"), (3, 5, "new")]
    frame = lambda rows: spark.createDataFrame(rows, "label_id long, line_no int, text string")
    merged = lines.merge_passes(frame(first), frame(second))
    got = sorted(tuple(r) for r in merged.select("label_id", "new_line", "pass", "line_no", "text").collect())
    assert got == [(1, 0, 1, 0, "One, two"), (1, 1, 1, 1, "three."), (1, 2, 1, 2, "..."), (1, 3, 2, 1, "Four!"), (2, 0, 1, 0, "one two"), (2, 1, 2, 0, "three"), (3, 0, 2, 5, "new")]
    assert merged._jdf.queryExecution().optimizedPlan().toString().count(tx.PLAIN_TEXT) == 1


def test_words_that_stand_together_are_shuffled_as_one_row(spark):
    rows = [(1, 0, 2, "b", 50.0), (1, 0, 1, "a", 60.0), (1, 1, 1, "c", 70.0), (1, 1, 2, "", 80.0), (1, 0, 3, "d", 71.0), (2, 0, 1, "e", -1.0), (2, 0, 2, None, 5.0)]
    words = spark.createDataFrame(rows, "label_id long, line_no int, word_no int, text string, conf double").coalesce(1)
    found = sorted(tuple(r) for r in lines.group_words(words).collect())
    assert found == [(1, 0, "a b d", 60.333), (1, 1, "c ", 75.0), (2, 0, "", 5.0)]
    batch = pa.RecordBatch.from_pylist([dict(zip(words.columns, r)) for r in rows[:5]], pa.schema([("label_id", pa.int64()), ("line_no", pa.int32()), ("word_no", pa.int32()), ("text", pa.string()), ("conf", pa.float64())]))
    assert [x["texts"] for out in lines._runs([batch]) for x in out.to_pylist()] == [["b", "a"], ["c", ""], ["d"]]
