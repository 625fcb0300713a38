"""Similarity of strings. Scores are whole numbers from 0 to 100, rounded half to even."""

from __future__ import annotations

import difflib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one word-wide step a character of b."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    free = full = (1 << len(a)) - 1
    for c in b:
        met = free & at.get(c, 0)
        free = ((free + met) | (free - met)) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """(FZ1)"""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_ratio(a: str, b: str) -> float:
    """(FZ2)"""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter to a part of the longer that is as long, or shorter at its ends; where that is below `least`, any number below it. (FZ3)"""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, size = len(short), len(long)
    # What a part has in common with the short text is at most their common characters in whatever order, counted as the part moves on.
    spare, common, bounds = Counter(short), 0, []
    most = (spare & Counter(long)).total()
    if 200.0 * most / (n + most) < least:  # as high as a part with so many characters in common can come
        return 0.0
    for i in range(1 - n, size):
        if i + n <= size:
            c = long[i + n - 1]
            spare[c] -= 1
            common += spare[c] >= 0
        if i > 0:
            c = long[i - 1]
            common -= spare[c] >= 0
            spare[c] += 1
        bounds.append((200.0 * common / (n + min(size, i + n) - max(0, i)), i))
    best, tried = 0.0, set()
    for bound, i in sorted(bounds, reverse=True):
        if bound <= best or bound < least:
            break
        part = long[max(0, i) : i + n]
        if part not in tried:
            tried.add(part)
            best = max(best, indel_ratio(short, part))
    return best


def _pairwise(score):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        known: dict[tuple, int | None] = {}
        out = []
        for pair in zip(a.to_pylist(), b.to_pylist()):
            if pair not in known:
                known[pair] = None if None in pair else round(score(*pair))
            out.append(known[pair])
        return pa.array(out, pa.int32())

    return F.arrow_udf(run, T.IntegerType())


ratio = _pairwise(indel_ratio)
token_sort_ratio = _pairwise(sorted_ratio)
best_part_ratio = _pairwise(partial_ratio)


def best_part_ratio_from(least: int):
    """best_part_ratio for those who ask only whether it reaches `least`, and for the score if it does: much the faster, as few texts do."""
    return _pairwise(lambda a, b: partial_ratio(a, b, least - 0.5))


def text_score(a, b) -> Column:
    """The better of the plain ratio and the ratio of sorted words less 2. (MT3)"""
    return F.greatest(ratio(a, b), token_sort_ratio(a, b) - 2)


def length_bound(a: Column, b: Column) -> Column:
    """No ratio of texts of these lengths can exceed this, whatever the characters: a filter that comes before ratio()."""
    return 200.0 * F.least(a, b) / F.greatest(a + b, F.lit(1))


def one_digit_apart(a: Column, b: Column) -> Column:
    """Equally long digits that differ in one place. (FZ7)"""
    a, b = a.cast("string"), b.cast("string")
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.length(a) == F.length(b)) & (differ == 1)


def _each_pair(one, first: pa.Array, second: pa.Array) -> list:
    """one(a, b) of each pair of arrays, found once for pairs that repeat: many labels print a statement alike."""
    known: dict[tuple, list] = {}
    out = []
    for a, b in zip(first.to_pylist(), second.to_pylist()):
        pair = tuple(a or ()), tuple(b or ())
        if pair not in known:
            known[pair] = one(list(pair[0]), list(pair[1]))
        out.append(known[pair])
    return out


def _differences(expected: pa.Array, found: pa.Array) -> pa.Array:
    def one(a: list, b: list) -> list:
        rows = []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag != "equal":
                join = " ".join
                rows.append({"kind": tag, "at": i, "found_at": k, "expected": join(a[i:j]), "found": join(b[k:m]), "expected_before": join(a[max(0, i - 5) : i]), "expected_after": join(a[j : j + 5]), "found_before": join(b[max(0, k - 5) : k]), "found_after": join(b[m : m + 5])})
        return rows

    text = [(n, pa.string()) for n in ("expected", "found", "expected_before", "expected_after", "found_before", "found_after")]
    return pa.array(_each_pair(one, expected, found), pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("found_at", pa.int32()), *text])))


#: Word differences with five words of context on each side, from two arrays of words. (FZ5, WR9)
word_diff = F.arrow_udf(
    _differences,
    T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("found_at", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("expected", "found", "expected_before", "expected_after", "found_before", "found_after")])),
)


def _alignment(wanted: pa.Array, read: pa.Array) -> pa.Array:
    def one(a: list, b: list) -> list:
        places = [None] * len(b)
        for block in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
            places[block.b : block.b + block.size] = range(block.a, block.a + block.size)
        return places

    return pa.array(_each_pair(one, wanted, read), pa.list_(pa.int32()))


#: For each word of the second array its place in the first, null where it has none. (WR12)
aligned = F.arrow_udf(_alignment, T.ArrayType(T.IntegerType()))
