"""Lines are scored once each, and only as far as the score can matter."""

import random

from veriloom.functions import similarity
from veriloom.functions.similarity import indel_ratio, partial_ratio
from veriloom.operators import statement


def test_parts_that_cannot_be_the_best_are_not_compared(monkeypatch):
    rng, asked = random.Random(5), []
    for _ in range(3000):
        letters = rng.choice(["abc ", "government warning"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(n))) for n in (12, 30))
        short, long = sorted((a, b), key=len)
        best = max((indel_ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))), default=0.0) if short else (0.0 if long else 100.0)
        assert partial_ratio(a, b) == best
        assert partial_ratio(a, b, 74.5) == best if best >= 74.5 else partial_ratio(a, b, 74.5) < 74.5
    monkeypatch.setattr(similarity, "indel_ratio", lambda *x: asked.append(x) or indel_ratio(*x))
    assert similarity.partial_ratio("government warning", "customer 000000001", 74.5) == 0.0 and not asked
    assert similarity.partial_ratio("government warning", "government warning 1 according to") == 100.0 and len(asked) == 1


def test_starts_score_each_line_once(spark):
    lines = [(1, "a", 0, "Some brand"), (1, "a", 1, "GOVERNMENT"), (1, "a", 2, "WARNING: (1) According"), (1, "b", 0, "GOVERNMENT WARNING: (1)"), (2, "a", 0, "front"), (2, "a", 1, "According to the Surgeon General, women"), (3, "a", 0, "nothing")]
    rows = spark.createDataFrame([(*x, None, None, None, None) for x in lines], "label_id long, frame string, line_no int, text string, left int, top int, width int, height int")
    found = statement.starts(statement.ranked_lines(rows))
    assert sorted(tuple(r) for r in found.select("label_id", "frame", "start", "head_lines", "nth").collect()) == [(1, "a", 1, 2, 1), (1, "b", 0, 1, 1), (2, "a", 1, 0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") <= 3


def test_headings_are_weighed_in_one_pass_over_the_words(spark):
    from veriloom.operators import passage

    ink = [(label, 0, k, w, 20, 400 if k < 2 and label == 1 else 200, 200) for label in (1, 2) for k, w in enumerate("GOVERNMENT WARNING: ACCORDING THE SURGEON".split())]
    words = spark.createDataFrame(ink, "label_id long, line_no int, word_no int, text string, height int, area int, boundary int")
    statements = spark.createDataFrame([(i, [0], [0], "GOVERNMENT WARNING:") for i in (1, 2)], "label_id long, lines array<int>, head_lines array<int>, heading_text string")
    found = passage.heading_weights(words, statements)
    assert {r.label_id: (r.bold, r.bold_ratio) for r in found.collect()} == {1: ("PASS", 2.0), 2: ("REVIEW", 1.0)}
    once = passage.heading_words(words, statements)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == once + 3  # the words and their lines, and the labels
