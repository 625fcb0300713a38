"""Near pairs against all pairs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.operators import pairs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_pairs_within_edits(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(60)} | {"", "é", "éa", "abcabcabcabc", "abcabcbcabc", "xabcabcabcabcx"}
    df = spark.createDataFrame([(w, 1) for w in [*words, "abc", "abc"]] + [(None, 1)], "text string, other int")
    words = sorted(words | {"abc"})
    for most in (1, 2, 4):
        want = sorted((a, b, edits(a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if edits(a, b) <= most)
        assert sorted(tuple(r) for r in pairs.within_edits(df, most).collect()) == want


def test_numbers_one_digit_apart(spark):
    values = [7, 17, 71, 77, 170, 177, 777, 1777, 1077, 17, -17, 0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value long")
    apart = lambda a, b: len(str(a)) == len(str(b)) and sum(x != y for x, y in zip(str(a), str(b))) == 1
    want = sorted({(a, b) for a in values for b in values if a < b and apart(a, b)})
    assert sorted(tuple(r) for r in pairs.one_digit_apart(df).collect()) == want


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_a_common_piece_is_certain(a, b):
    d = edits(a, b)
    cut = lambda i: i * len(a) // (d + 1)
    assert any(a[cut(i) : cut(i + 1)] == b[max(cut(i) + s, 0) : max(cut(i) + s, 0) + cut(i + 1) - cut(i)] for i in range(d + 1) for s in range(-d, d + 1))
