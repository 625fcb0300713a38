"""Collocations against a plain count; sketches against exact counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from veriloom.llm import collocations as C


def plain(docs, least, best=2000):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    cands = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    covered = {}
    for (lang, w), f in cands.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                covered[lang, w[i : i + n]] = max(f, covered.get((lang, w[i : i + n]), 0))
    rows = []
    for (lang, w), a in cands.items():
        if 100 * covered.get((lang, w), 0) < 80 * a:
            score, _, left, right = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            rows.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= best:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(spark, docs, **kw):
    df = spark.createDataFrame([(i, l, t, "x", 1) for i, (l, t) in enumerate(docs)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in C.collocations(df, **kw).collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "é", "Ünder", "x1", " odd", "\x1c", "a-b"]
    marks = [" ", "  ", "\t", ". ", ", ", "\n", "; ", "\r\n", " \x0b", "?", "!", ":"]
    docs = []
    for i in range(n):
        parts = [rng.choice(words) + rng.choice(marks[:3] * 6 + marks) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(parts) + "New York City Hall " * (i % 3)))
    return docs + [("en", None), (None, None), ("fr", ""), ("en", "of the " * 200), ("en", "of the " * 200)]


def test_equals_a_plain_count(spark):
    docs = texts(1)
    assert found(spark, docs, least=5) == plain(docs, 5)


def test_rounds_and_windows_cut_anywhere(spark, monkeypatch):
    for name, value in (("ROUND", 7), ("REMEMBERED", 4), ("WINDOW", 9)):
        monkeypatch.setattr(C, name, value)
    docs = texts(2, 25)
    assert found(spark, docs, least=3) == plain(docs, 3)


def test_a_narrow_sketch_loses_nothing(spark):
    docs = texts(3, 30)
    assert found(spark, docs, least=4, bits=3) == plain(docs, 4)


def test_best_of_each_language_through_groups(spark, monkeypatch):
    monkeypatch.setattr(C, "RANKED", 10)
    docs = [("en", " ".join(f"w{i} v{i}, w{i} v{i}" for i in range(400))), ("de", "a b " * 9)]
    assert found(spark, docs, least=2, best=3) == plain(docs, 2, 3)


def test_ties_go_by_phrase_and_empty_tables_give_nothing(spark):
    docs = [("en", "b c, a d, é f\nz 1;b c, a d, é f\nz 1")]
    assert [r[2] for r in sorted(found(spark, docs, least=2), key=lambda r: r[1])] == ["a d", "b c", "z 1", "é f"]
    assert found(spark, docs, least=2) == plain(docs, 2)
    assert found(spark, [], least=2) == [] and found(spark, [("en", None)], least=2) == []


def test_least_is_checked(spark):
    with pytest.raises(ValueError):
        C.phrase_counts(spark.createDataFrame([], "lang string, text string"), 256)


def test_merged_sketches_never_underestimate(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, 3000, dtype=np.uint64)[rng.integers(0, 3000, 40_000) ** 2 // 3000]
    rows = []
    for part in np.array_split(codes, 5):
        counts = np.zeros((2, 1 << 17), np.uint8)
        for half in np.array_split(part, 2):
            for own, cells in zip(counts, C._cells(half, 17)):
                C._add(own, cells)
        rows += C._slices(counts, 17)
    df = spark.createDataFrame([(r, s, bytes(c)) for r, s, c in rows], "row int, slice int, counts binary")
    merged = df.repartition("row", "slice").sortWithinPartitions("row", "slice").mapInArrow(C._merge(30), "row int, slice int, bits binary").collect()
    sketch = C.Sketch(17, [(r["row"], r["slice"], bytes(r["bits"])) for r in merged])
    known, counts = np.unique(codes, return_counts=True)
    passed = sketch.may_be_frequent(known)
    assert passed[counts >= 30].all() and passed[counts < 15].mean() < 0.05


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_007_199_254_740_993
    rows = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 2)]
    assert C.scored(spark.createDataFrame(rows, "lang string, phrase string, n int, f long")).first()["score"] == 2_000_000 * big // (2 * big + 2)
