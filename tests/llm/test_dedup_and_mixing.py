import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from veriloom.llm import exact_dedup, mixing, simhash
from veriloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([tuple(r) + (None,) * (len(schema.split(",")) - len(r)) for r in rows], schema)


def ascii_lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


ODD = [(None, "a b c"), (None, "A b c"), (1, None), (2, ""), (3, "ÄB c"), (4, "äb c"), (5, "ÄB C"), (5, "ÄB C"), (6, "word " * 5000), (7, "word " * 5000), (8, " \t\n"), (9, "x"), (9, "y")]


@pytest.mark.parametrize("rows", [ODD, [], [(1, "a")]])
def test_exact_dedup_against_groups(spark, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t)].append(i)
    found = exact_dedup.mark_copies(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    kept = defaultdict(int)
    for r in found:
        ids = groups[ascii_lower(r["text"])]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (best, len(ids), hashlib.sha256(ascii_lower(r["text"]).encode()).hexdigest())
        assert not r["kept"] or r["doc_id"] == best
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) <= {1}


def test_exact_dedup_does_not_depend_on_the_batch(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, ODD)
    views = [sorted(map(str, exact_dedup.mark_copies(docs, cut).select("doc_id", "keep_id", "group_size", "text_sha256").collect())) for cut in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))]
    assert views[0] == views[1] == views[2]


def test_exact_dedup_replaces_clashing_columns_and_keeps_others(spark):
    docs = frame(spark, [(1, "a", "x", "q", 7), (2, "A", "x", "q", 7)], "doc_id long, text string, kept string, keep_id string, key long")
    found = exact_dedup.exact_dedup(docs.withColumnRenamed("key", "n"))
    assert found.columns == ["doc_id", "text", "kept", "keep_id", "n"] and [r["doc_id"] for r in found.collect()] == [2]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 60_000])
def test_binary_fuse_filter(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    f = exact_dedup.build_filter(keys)
    assert exact_dedup.may_contain(keys, *f).all()
    assert exact_dedup.may_contain(keys + np.uint64(1), *f).mean() < (0.02 if n >= 1000 else 0.6)


def brute_fingerprint(text, k):
    words = ascii_lower(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius):
    ids, out = list(prints), {}
    for start in ids:
        if start not in out:
            group, todo = {start}, [start]
            while todo:
                x = todo.pop()
                for y in ids:
                    if y not in group and (prints[x] ^ prints[y]).bit_count() <= radius:
                        group.add(y)
                        todo.append(y)
            out |= {g: min(group) for g in group}
    return out


def near_texts(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(rng.choice([0, 1, 3, 4, 60, 300]))) for _ in range(n // 3)]
    while len(texts) < n:
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(3)):
            if words:
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(9))
        texts.append(rng.choice([" ", "\t", "\n "]).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return texts


def test_simhash_against_brute_force(spark):
    texts = near_texts(1, 240) + [None, "", "é à ü x y", "É à ü x y"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    prints = {i: brute_fingerprint(t, 4) for i, t in rows}
    expected = brute_groups(prints, 4)
    found = simhash.group_near_copies(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


def test_simhash_near_dedup_keeps_one_of_a_group(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(30):
        words, members = fresh(200), []
        for k in range(4):
            own = list(words)
            for at in rng.sample(range(200), min(k, 3)):
                own[at] = "edit"
            members.append(len(rows))
            rows.append((len(rows), " ".join(own)))
        groups.append(members)
    rows += [(1000 + i, " ".join(fresh(150))) for i in range(40)] + [(None, "same words here again and again"), (None, "same words here again and again"), (5000, "twice the same id one"), (5000, "twice the same id one"), (5000, "Twice the same id one")]
    words = fresh(200)
    rows += [(6000, " ".join(words)), (6000, " ".join(["edit", *words[1:]]))]
    kept = [r["doc_id"] for r in simhash.near_dedup(frame(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted([m[0] for m in groups] + [1000 + i for i in range(40)] + [5000, 6000])
    assert kept.count(None) == 1
    assert simhash.near_dedup(frame(spark, [])).count() == 0


def test_simhash_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    expected = brute_groups({v: v for v in values}, 4)
    for size in (16, 4096):
        monkeypatch.setattr(simhash, "TREE_SIZE", size)
        links = simhash.linked(spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long"), 4)
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links).collect()}
        groups = defaultdict(set)
        for v in values:
            groups[roots.get(v, v)].add(v)
        wanted = defaultdict(set)
        for v, root in expected.items():
            wanted[root].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (None, "solo text here that is alone")]
    found = simhash.group_near_copies(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["_tops"]) for r in found) == [(0, 0, 1), (0, 4, 2), (0, 4, 2), (4, 4, 2), (4, 4, 2), (9, 9, 1)]
    assert simhash.group_near_copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n, masks", [(0, 5), (10**5, 5), (10**7, 15), (10**9, 35), (10**12, 70)])
def test_block_masks_cover_every_close_pair(n, masks):
    found, rng = simhash.block_masks(n, 4), random.Random(n)
    assert len(found) == masks
    for _ in range(300):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(difference & m == 0 for m in found)


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * weight[s] / total for s in rest}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_targets_and_words_taken(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80, 700])), "en", "hot") for i in range(200)]
    rows += [(1000 + i, "a b\tc d " * rng.randrange(30), "en", rng.choice(["Z", "a", "é", "\U0001f600", "￮", None, "tiny"])) for i in range(150)]
    rows += [(None, "one two", "en", "a"), (5000, None, "en", "void"), (5001, "x", "en", None), (5001, "x", "en", None)]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    targets = brute_targets(dict(sizes))
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= mixing.BLOCK, (s, taken[s], t)
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix(frame(spark, [])).count() == 0 and [r["taken"] for r in mixing.mix(frame(spark, [(1, None)])).collect()] == [0]


def test_mixing_uses_each_block_once_a_pass(spark):
    rows = [(i, "w " * 1000, "en", "a" if i % 3 else "b") for i in range(60)]
    _, plan, mixed = mixing.mix_plan(frame(spark, rows))
    plan = {r["src"]: r for r in plan.collect()}
    uses = defaultdict(lambda: defaultdict(int))
    for r in mixed.collect():
        uses[r["src"]][r["block"]] += 1
    for s, p in plan.items():
        assert sum(uses[s].values()) == p["n"] and set(uses[s]) <= set(range(p["blocks"]))
        assert set(uses[s].values()) <= {int(p["passes"]), int(p["passes"]) + 1}


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_a_bijection(spark, n):
    from pyspark.sql import functions as F

    got = [r["x"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x")).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))
