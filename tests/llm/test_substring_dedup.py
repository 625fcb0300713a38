import random
from collections import Counter

import pytest

from veriloom.llm import substring_dedup

DOCS = "doc_id long, text string, source string"


def brute(texts, window):
    streams = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(s[i : i + window]) for s in streams for i in range(len(s) - window + 1))
    out = []
    for s in streams:
        gone = set()
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(s), len(gone), b" ".join(w for i, w in enumerate(s) if i not in gone).decode()))
    return out


def corpus(seed, n, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("abc") * rng.randrange(1, 3) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randrange(window - 2, 3 * window))] for _ in range(6)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            kind = rng.random()
            if kind < 0.5:
                words += [word() for _ in range(rng.randrange(2 * window))]
            elif kind < 0.8:
                words += rng.choice(passages)[rng.randrange(3) :]
            elif kind < 0.9:
                words += ["same"] * rng.randrange(2 * window)
            elif texts:
                words += rng.choice(texts).split()
        texts.append(rng.choice([" ", "\t", " \n"]).join(words))
    return texts + [None, "", "  \t", "É é É"]


@pytest.mark.parametrize("seed, window, prefix, group", [(1, 35, 12, 64_000_000), (2, 8, 3, 64_000_000), (3, 8, 3, 1), (4, 6, 6, 64_000_000), (5, 35, 12, 1), (6, 8, 2, 4_000)])
def test_against_counting_all_windows(spark, monkeypatch, seed, window, prefix, group):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 20 if seed % 2 else 2_000)
    texts = corpus(seed, 90, window)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "twice"), (None, texts[5], None)]
    expected = brute([r[1] for r in rows], window)
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), window, prefix).collect()
    wanted = sorted((str(r[0]), str(r[2]), *e) for r, e in zip(rows, expected))
    assert sorted((str(r["doc_id"]), str(r["source"]), r["n_words"], r["n_removed"], r["text"]) for r in found) == wanted


def test_empty_and_clashing_columns(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "a b", "k", 9, {"x": [1]})], "doc_id long, text string, key string, n_words int, extra map<string,array<int>>")
    assert substring_dedup.remove_repeats(docs).collect()[0].asDict() == {"doc_id": 1, "text": "a b", "key": "k", "extra": {"x": [1]}, "n_words": 2, "n_removed": 0}


def brute_repeats(stretches, window):
    """Every repeat of window words or more that not all of its places extend to either side; where a stretch begins or ends, nothing does."""
    streams = [x.split() for x in stretches]
    places = {}
    for at, s in enumerate(streams):
        for i in range(len(s)):
            for j in range(i + window, len(s) + 1):
                places.setdefault(tuple(s[i:j]), []).append((at, i))

    def extends(neighbours):
        return None not in neighbours and len(set(neighbours)) == 1

    found = {}
    for words, where in places.items():
        before = [streams[at][i - 1] if i else None for at, i in where]
        behind = [streams[at][i + len(words)] if i + len(words) < len(streams[at]) else None for at, i in where]
        if len(where) > 1 and not extends(before) and not extends(behind):
            found[words] = sorted(where)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_deep_nodes_are_the_maximal_repeats(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 4])
    letters = ["a", "ab", "a\x01", "\u00e9"][: rng.choice([2, 4])]
    stretches = sorted({" ".join(rng.choice(letters) for _ in range(rng.randrange(window, 25))).encode() for _ in range(8)})
    found = {}
    for depth, where in substring_dedup.maximal_repeats(stretches, window):
        at, k = where[0]
        words = tuple(stretches[at].split()[k : k + depth])
        assert len(words) == depth and words not in found
        found[words] = sorted(where)
    assert found == brute_repeats(stretches, window)


def test_lengths_of_prefixes():
    assert substring_dedup.depths(35, 12) == [12, 20, 25, 29, 31, 33, 34, 35]
    assert substring_dedup.depths(6, 6) == [6]


def test_large_groups_are_split_and_copies_are_not(spark, monkeypatch):
    """Windows that share 12 words are told apart by longer prefixes; copies of one stretch stay one piece."""
    rng = random.Random(9)
    head = [f"h{i}" for i in range(12)]
    pieces = []
    for d in range(40):
        tail = [f"t{d % 8}"] * 8 + [f"u{rng.randrange(3)}_{i}" for i in range(15)]
        pieces.append((7, 7, bytes([d]), 0, " ".join(head + tail).encode(), 1 + d % 2))
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 2_000)
    found = substring_dedup.split_groups(spark.createDataFrame(pieces, substring_dedup.PIECES), 35, 12).collect()
    times = Counter()
    for row in pieces:
        times[row[4]] += row[5]
    assert sorted(bytes(r["digest"]) for r in found) == sorted(r[2] for r in pieces if times[r[4]] > 1)
    assert all(r["ranges"] == [0, 35] for r in found)
