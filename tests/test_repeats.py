import pyarrow as pa

import __spark_entry__
from veriloom.functions import figures
from veriloom.operators import geometry


def test_a_text_that_repeats_is_read_once():
    asked = []

    def parse(text):
        asked.append(text)
        return figures.parse_volume(text)

    texts = ["750 mL", None, "1 L"] * 50
    found = figures._each(parse, figures._VOLUME)(pa.array(texts, pa.string())).to_pylist()
    assert found == [figures.parse_volume(t) for t in texts]
    assert sorted(asked, key=str) == ["1 L", "750 mL", None]


def test_sums_before_each_size():
    sizes = pa.array([[9, 9], [1, 2, 3], None, [], [5]], pa.list_(pa.int32()))
    assert geometry._sums_before(sizes).to_pylist() == [[0, 9], [0, 1, 3], [], [], [0]]
    assert geometry._sums_before(sizes.slice(1)).to_pylist() == [[0, 1, 3], [], [], [0]]


def test_lines_of_documents_are_made_once(spark):
    found = __spark_entry__.queries()["evidence_words"](spark, "/root/testdata/sf0.001")
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_without_a_hyphen_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F
    from veriloom.operators import statement

    lines = spark.range(400).select(F.col("id").alias("label_id"), F.lit(0).alias("line_no"), F.lit("no hyphen here").alias("text"))
    vocabulary = spark.createDataFrame([("whole",)], "word string").hint("merge")
    found = statement.rejoin_hyphenated(lines, vocabulary, "label_id")
    plan = found._jdf.queryExecution().optimizedPlan()
    assert "_key" in plan.toString() and found.count() == 400
    joins = [plan]
    while joins and joins[0].nodeName() != "Join":
        joins = [c for x in joins for c in (x.children().apply(i) for i in range(x.children().size()))]
    keys = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, joins[0].children().apply(0)).select("_key", spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0))
    assert keys.distinct().count() > 300
