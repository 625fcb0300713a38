"""The output shards of the mixture against the documents' own words."""

import random
from collections import defaultdict

from test_dedup_and_mixing import frame

from veriloom.llm import mixing


def test_mixture_holds_the_words_of_the_documents(spark):
    rng = random.Random(9)
    rows = [(i, " \t\n "[i % 4] * (i % 2) + "\n ".join(f"d{i}_{k}" for k in range(rng.choice([0, 1, 5, 80, 700]))), "en", rng.choice(["a", "b", None, "tiny"])) for i in range(80)]
    rows += [(None, "n0 n1 n2", "en", "a"), (500, None, "en", "a"), (501, "t0 t1", "en", "b"), (501, "t0 t1", "en", "b"), (501, "u0 u1", "en", "b")]
    docs = frame(spark, rows)
    _, plan, _ = mixing.mix_plan(docs)
    slots = {r["source"]: r["n"] for r in plan.collect()}
    found = mixing.mixture(docs).collect()
    of, numbers, counts = defaultdict(set), defaultdict(list), defaultdict(int)
    for _, text, _, source in rows:
        of[source] |= set((text or "").split())
    words = defaultdict(int)
    for r in found:
        own = r["words"].split(" ")
        assert 1 <= len(own) <= mixing.BLOCK and set(own) <= of[r["source"]]
        for a, b in zip(own, own[1:]):  # neighbours of one document stay neighbours
            if a.split("_")[0] == b.split("_")[0] and a[0] == "d":
                assert int(b.split("_")[1]) == int(a.split("_")[1]) + 1
        numbers[r["shard"]].append(r["slot"])
        counts[r["source"]] += 1
        for w in own:
            words[w] += 1
    assert dict(counts) == {s: n for s, n in slots.items() if n}
    assert all(sorted(x) == list(range(len(x))) for x in numbers.values())
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    for i, text, _, _ in rows:
        if i is not None and i < 500:
            assert taken[i] == sum(words[w] for w in (text or "").split())
    assert taken[501] == sum(words[w] for w in ("t0", "t1", "u0", "u1")) and mixing.mixture(frame(spark, [])).count() == 0
