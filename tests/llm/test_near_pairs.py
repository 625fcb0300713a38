"""The pipeline's near-dedup stage against brute force on pairs around its limit and on short texts."""

import random

from test_dedup_and_mixing import frame
from test_pipeline import brute_near, shingles

from veriloom.llm import simhash


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, low, high):
    """A copy with words changed, until its similarity is under high."""
    own = list(words)
    while similarity(" ".join(words), " ".join(own)) >= high:
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
    return own if similarity(" ".join(words), " ".join(own)) >= low else None


def test_near_dedup_finds_all_pairs_of_similarity_0_8_and_no_others(spark):
    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for low, high in ((0.7, 0.75), (0.75, 0.8), (0.8, 0.82), (0.8, 0.85), (0.85, 0.9)):
        for _ in range(60):
            words = fresh(rng.choice([49, 120, 450]))
            if own := edited(rng, words, low, high):
                texts += [" ".join(words), " ".join(own)]
    for n in range(1, 16):  # one word added, or the last one changed, and words repeated
        for _ in range(10):
            words = fresh(n)
            texts += [" ".join(words), " ".join([*words, "more"])]
            words = fresh(n)
            texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words, *words])]
    line = " ".join(fresh(30))  # a line that many texts hold
    texts += [f"{line} {' '.join(fresh(k % 40))}" for k in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    kept = {r["doc_id"] for r in simhash.near_dedup(frame(spark, rows).repartition(5)).collect()}
    assert kept == brute_near(sorted(rows))


def test_near_dedup_does_not_depend_on_what_simhash_proposes(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(k, " ".join([*words[: 2 * k], *words[2 * k + 2 :]])) for k in range(40)] + [(100 + k, f"alone {k} " + " ".join(words[:20])) for k in range(5)]
    monkeypatch.setattr(simhash, "COMPARED", 3)
    for radius in (0, 400):
        assert {r["doc_id"] for r in simhash.near_dedup(frame(spark, rows), radius=radius).collect()} == brute_near(rows)


def test_a_passage_that_many_documents_quote_makes_no_pairs_of_them(spark, monkeypatch):
    """Once a table is large, a sample of it knows too few of the shingles that many documents hold."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, twin = " ".join(fresh(40)), fresh(60)
    rows = [(k, f"{' '.join(fresh(60))} {passage}") for k in range(120)] + [(500, " ".join(twin)), (501, " ".join([*twin, "more"]))]
    asked, found = [], simhash.verified

    def verified(pairs, *rest):
        asked.append(pairs.count())
        return found(pairs, *rest)

    monkeypatch.setattr(simhash, "common_shingles", lambda docs, shingle: simhash.np.zeros(0, simhash.np.uint64))
    monkeypatch.setattr(simhash, "verified", verified)
    assert {r["doc_id"] for r in simhash.near_dedup(frame(spark, rows), radius=0).collect()} == brute_near(rows)
    assert sum(asked) <= 1
