"""The search for values looks closely only at spans that can be the best."""

import random
import re


from pyspark.sql.functions import col

from veriloom.config import THRESHOLDS
from veriloom.functions.similarity import indel_ratio
from veriloom.functions.text import _loose, _strict, normalize_loose, normalize_strict
from veriloom.operators import matching


def test_a_value_that_stands_on_the_label_is_compared_with_spans_of_its_length_only(spark):
    lines = spark.createDataFrame([(1, 0, "large ring"), (1, 1, "of the old mill"), (1, 2, "LARGE RING")], "label_id long, line_no int, text string")
    values = spark.createDataFrame([(1, "a", "Large Ring"), (1, "b", "large rink")], "label_id long, key string, expected string")
    rows = matching.spans(values, lines, floor=60).collect()
    assert sorted((r["line_no"], r["candidate"]) for r in rows if r["key"] == "a") == [(0, "large ring"), (1, "mill large"), (1, "of the old"), (2, "large ring")]
    assert len([r for r in rows if r["key"] == "b"]) > 2  # nothing equal, so all spans of fitting lengths


def test_plain_texts_have_the_same_forms_either_way(spark):
    texts = ["a b", "A  b", " a", "a ", "Alc 5", "45% ok", "5%ABV", "x\n", "x y\nz", "", "é b", "a_b", "vol", "Volume One", "9 to 5", "a\tb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for whole, slow in ((normalize_loose, _loose), (normalize_strict, _strict)):
        assert not [r for r in rows.select("t", whole("t").alias("a"), slow(col("t")).alias("b")).collect() if r["a"] != r["b"]]


def best_spans(values, lines, floor):
    """By brute force, over words that are their own loose forms when lower-cased; - is a word that has none."""
    out = {}
    for label, key, expected in values:
        want, found = " ".join(w.lower() for w in expected.split() if w != "-"), []
        n = len(expected.split())
        own = sorted((i, t.split()) for at, i, t in lines if at == label)
        for x, (i, _) in enumerate(own):
            words = [(w, j) for j, ws in own[x : x + THRESHOLDS.locate_max_lines] for w in ws]
            for a in range(len(own[x][1])):
                for size in range(max(1, n - THRESHOLDS.span_slack), n + THRESHOLDS.span_slack + 1):
                    span = words[a : a + size]
                    candidate = " ".join(w.lower() for w, _ in span if w != "-")
                    if len(span) == size and candidate and (score := round(indel_ratio(want, candidate))) >= floor:
                        text = re.sub(r"^[ -]+|[ -]+$", "", " ".join(w for w, _ in span))
                        found.append((score, text == re.sub(r"^[ -]+|[ -]+$", "", expected), -i, -span[-1][1], -a, -size, text))
        if found:
            top = max(found)
            out[label, key] = (top[-1], top[0], -top[2], -top[3])
    return out


def test_located_spans_equal_brute_force(spark):
    rng = random.Random(3)
    lines, values = [], []
    for label in range(60):
        vocabulary = ["Old", "old", "mill", "Mil", "ring", "rng", "-", "oak"] if label % 3 else ["x" * 99 + "A", "x" * 100, "x" * 99 + "a", "-", "y" * 98]
        lines += [(label, i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 5)))) for i in range(rng.randint(1, 5))]
        values += [(label, k, " ".join(rng.choices([v for v in vocabulary if v != "-"], k=rng.randint(1, 4)))) for k in ("a", "b")]
    found = matching.locate(spark.createDataFrame(values, "label_id long, key string, expected string"), spark.createDataFrame(lines, "label_id long, line_no int, text string"))
    assert {(r["label_id"], r["key"]): (r["text"], r["score"], r["line_start"], r["line_end"]) for r in found.collect()} == best_spans(values, lines, THRESHOLDS.find_floor)
