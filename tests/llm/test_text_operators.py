import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import chat_format, decontamination, licence_scan, quality, toxicity, url_filter

DOCS = "doc_id long, text string, source string"


def fresh(rng, n):
    return " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randrange(2, 9))) for _ in range(n))


# URL filter


def brute_rule(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == (own := r.split("/", 1)[0]) or host.endswith("." + own)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/es/1", "https://example.org/en/1x?q=/z#f", "http://xexample.org/es/", "ftp://b.com/fr/ü?x", "http://com/de/", "http://É.Com/fr/a://b", "x://net?/com/fr/", "http://net/\n#a", "http://a.net/" + "s/" * 5000, "http://a.com/de/1"]


def test_url_rules_against_parsing_by_hand(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] + [(3, URLS[3], None)], "page_id long, url string, verdict string")
    found = url_filter.judge_urls(pages).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path, rule, verdict = brute_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or "allow")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_templates_are_learned_from_labelled_pages(spark):
    rng = random.Random(1)
    slug = lambda: "".join(rng.choice("bcdfgh") for _ in range(9))
    rules = (("block", "shop.net/x/a"), ("allow", "shop.net/good/a"))
    urls = [f"http://shop.net/x/{first}{slug()}/{i}" for i, first in enumerate(["a"] * 60 + ["z"] * 40)]
    urls += [f"http://shop.net/good/{first}{slug()}" for first in ["a"] * 60 + ["z"] * 40] + ["http://else.net/x/q"]
    found = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in found:
        expected = "block" if r["host"] == "shop.net" and r["path"].startswith("/x/") else "allow"
        assert r["verdict"] == expected, (r["url"], r["rule"])
    judged = url_filter.with_parts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).withColumn("label", url_filter.rule_columns(rules)[1])
    tree = {r["template"] for r in url_filter.templates(judged).where("host = 'shop.net'").collect()}
    assert tree == {"/x/*/**", "/good/**"}


def brute_tree(pages):
    """{(host, skeleton): (template, purity)} of rows (host, skeleton, label), one host and one branch at a time."""
    overall_bad = sum(y == "block" for *_, y in pages) / max(1, sum(y is not None for *_, y in pages))
    counts = lambda rows: (sum(y == "allow" for *_, y in rows), sum(y == "block" for *_, y in rows))
    out = {}

    def purity(rows, parent):
        good, bad = counts(rows)
        return (bad + url_filter.PRIOR * parent) / (good + bad + url_filter.PRIOR)

    def grow(rows, level, template, share):
        skeletons = {r[1] for r in rows}
        if len(skeletons) == 1 or all(len(x) < level for x in skeletons):
            for h, x, _ in rows:
                out[h, x] = "/" + "/".join(template + list(x[level:])), share
            return
        for r in [r for r in rows if len(r[1]) < level]:
            out[r[0], r[1]] = "/" + "/".join(template), share
        kids = {}
        for r in rows:
            if len(r[1]) >= level:
                kids.setdefault(r[1][level] if len(r[1]) > level else None, []).append(r)
        named = {}
        for k, own in kids.items():
            rare = k is not None and sum(x is not None for x in kids) >= url_filter.KIDS and len(own) < url_filter.SUPPORT
            named.setdefault("*" if rare else k, []).extend(own)
        labelled = {}
        for k, own in named.items():
            (g, b), (ag, ab) = counts(own), counts([r for x in named.values() for r in x])
            n, m = g + b, ag + ab - g - b
            apart = False
            if n and m:
                rate = ab / (n + m)
                apart = abs(b / n - (ab - b) / m) > url_filter.DIFFERENT * (rate * (1 - rate) * (1 / n + 1 / m)) ** 0.5
            labelled.setdefault(k if apart or (len(named) == 1 and any(len(r[1]) > level + 1 for r in own)) or k is None else "**", []).extend(own)
        for k, own in labelled.items():
            grow(own, level + 1, template + [k] * (k is not None), purity(own, share))

    for host in {r[0] for r in pages}:
        own = [r for r in pages if r[0] == host]
        grow(own, 0, [], purity(own, overall_bad))
    return out


def test_url_tree_against_recursion(spark):
    rng = random.Random(3)
    word = lambda n: rng.choice("abcdefgh") * rng.randrange(1, n)
    rows = []
    for i in range(3000):
        path = [rng.choice(["x", "y", "z"]), *[word(6) for _ in range(rng.choice([0, 1, 2, 4]))]]
        label = rng.choice(["block", "block", "allow"] if path[0] == "x" else ["allow", None]) if rng.random() < 0.5 else None
        rows.append((rng.choice(["a.net", "b.net", "c.net"]), "/" + "/".join(path), label if i % 3 else None))
    rows += [("deep.net", "/d" * 300, "block"), ("deep.net", "/d" * 3 + "/e", None), ("none.net", "", None), ("", "", None)]
    found = {(r["host"], tuple(r["skeleton"])): (r["template"], round(r["purity"], 9)) for r in url_filter.templates(spark.createDataFrame(rows, "host string, path string, label string")).collect()}
    wanted = brute_tree([(h, tuple(p[1:].split("/")) if p else (), y) for h, p, y in rows])
    assert found == {k: (t, round(p, 9)) for k, (t, p) in wanted.items()}


# Toxicity


def toxic_corpus(rng, n):
    bad = ["grubblewort", "snarkfoozle", "blatherskite", "nincompoopery"]
    rows = []
    for i in range(n):
        words = fresh(rng, rng.randrange(30, 300)).split()
        toxic = i % 4 == 0
        for _ in range(max(3, len(words) // 25) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = toxic_corpus(random.Random(4), 1200)
    docs = spark.createDataFrame([r[:2] + ("s",) for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(3000, 1), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([(found[i] >= 0.5) == bool(t) for i, _, t in held]) > 0.95
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()} == {i for i, s in found.items() if s < 0.5}


def test_toxicity_of_odd_texts_and_of_no_labels(spark):
    rows = toxic_corpus(random.Random(5), 60)
    model = toxicity.train([r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]], 0.2)
    odd = spark.createDataFrame([(None, None, None), (1, "", "s"), (2, "x " * 200_000, "s"), (2, "x " * 200_000, "s"), (3, "é\U0001f600", "s")], DOCS)
    for m in (model, toxicity.fit(odd.limit(0), odd.limit(0).select("doc_id", F.lit(1).alias("toxic"))), toxicity.train([], ["a"], 0.1), toxicity.train(["a"], [], 0.9)):
        scores = [r["toxicity"] for r in toxicity.score(odd, m).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_windows_are_compressed_as_by_hand():
    rows = toxic_corpus(random.Random(7), 120)
    model = toxicity.train([r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]], 0.25)
    scorer = toxicity.Scorer(model)

    def shorter(pair, line):
        toxic, ordinary = (toxicity._compressor(content).compress(line) for content in pair)
        return len(ordinary) - len(toxic)

    text = rows[0][1] + " " + "z" * 200 + " ... snarkfoozle!"
    windows = [p for w in text.lower().split() if w.strip(toxicity.EDGES) for p in [w.strip(toxicity.EDGES)[i : i + 64] for i in range(0, len(w.strip(toxicity.EDGES)), 64)]]
    first, second = scorer.saved(text)
    assert len(first) == len(windows)
    for w, a, b in zip(windows, first, second):
        line = f" {w} ".encode() * 4
        assert a == shorter(model.all, line)
        assert b == (shorter(model.seeming, line) if a >= toxicity.SEEMS else -500)


def test_toxicity_fit_on_doubtful_labels_and_names(spark):
    rows = toxic_corpus(random.Random(4), 40)
    docs = spark.createDataFrame([(f"d{i}", t, "x") for i, t, _ in rows], "doc_id string, text string, toxic string")
    labels = spark.createDataFrame([(f"d{i}", y) for i, _, y in rows] + [("d0", 0), ("d4", 0)], "doc_id string, toxic int")
    plain = toxicity.fit(docs, labels.where("not (doc_id in ('d0', 'd4') and toxic = 0)"))
    assert toxicity.fit(docs.repartition(7), labels.repartition(3)) == plain
    assert toxicity.drop_toxic(docs.withColumn("toxicity", F.lit(1)), plain).columns == ["doc_id", "text", "toxic", "toxicity"]


def test_toxicity_is_trained_in_tasks_as_by_one_process(spark, monkeypatch):
    """The driver gets dictionaries and features, no texts: training on it took some 200 MB of its memory."""
    rows = toxic_corpus(random.Random(9), 90) + [(90, "twice over", 0), (91, "twice over", 0), (92, None, 1)]
    docs = spark.createDataFrame([r[:2] + ("s",) for r in rows], DOCS)
    place = {r["doc_id"]: r["place"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("place")).collect()}
    rows.sort(key=lambda r: place[r[0]])
    sample = lambda of: [r[1] or "" for r in rows if of(r)]
    labels = lambda of: spark.createDataFrame([(r[0], r[2]) for r in rows if of(r)], "doc_id long, toxic int")
    few = lambda r: not r[2] or r[0] == 4
    wanted = [toxicity.train(sample(lambda r: r[2] and of(r)), sample(lambda r: not r[2] and of(r)), sum(r[2] for r in rows if of(r)) / sum(1 for r in rows if of(r))) for of in (bool, few)]
    here, found = [], toxicity._dictionaries
    monkeypatch.setattr(toxicity, "_dictionaries", lambda *a: (here.append(a), found(*a))[1])
    assert [toxicity.fit(docs.repartition(5), labels(of)) for of in (bool, few)] == wanted
    assert not here
    assert toxicity.fit(docs, labels(lambda r: r[2])).bias == 6 and toxicity.fit(docs, labels(lambda r: not r[2])).bias == -6


# Quality


def test_quality_on_held_out_documents(spark):
    rng = random.Random(6)
    good = [fresh(rng, rng.randrange(20, 400)) for _ in range(500)]
    bad = [" ".join(w.upper() + "!!" for w in fresh(rng, rng.randrange(20, 300)).split()) if i % 2 else " ".join([fresh(rng, 1)] * 120) for i in range(300)]
    rows = [(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in good] + [(t, 0) for t in bad])]
    docs = spark.createDataFrame([r[:2] + ("s",) for r in rows], DOCS)
    network = quality.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, quality int"))
    found = {r["doc_id"]: r["quality"] for r in quality.score(docs, network).collect()}
    assert np.mean([(found[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]) > 0.95


def test_network_in_blocks_equals_the_plain_convolution(monkeypatch):
    rng = np.random.default_rng(1)
    n = quality.train(["ab cd ef"] * 3, ["!! ##"] * 3, 0.5)
    for size in (0, 1, 3, 4, 130, 131, 132, 259, 260, 1000, 5000):
        data = bytes(rng.integers(0, 256, size, dtype=np.uint8))
        x = np.frombuffer(data + bytes(max(0, 4 - size)), np.uint8)
        seen = np.array([sum(n.filters[k][x[t + k]] for k in range(4)) for t in range(len(x) - 3)])
        starts = range(0, max(1, -(-len(seen) // quality.STEP) - 1) * quality.STEP, quality.STEP)
        plain = np.array([seen[s : s + quality.CHUNK].max(axis=0) for s in starts])
        for block in (quality.STEP, quality.BLOCK):
            monkeypatch.setattr(quality, "BLOCK", block)
            assert np.allclose(n.pooled(data), plain, atol=1e-4)


def test_quality_of_odd_texts(spark):
    odd = spark.createDataFrame([(None, None, None), (1, "", "s"), (2, "x " * 300_000, "s"), (3, "é", "s"), (3, "é", "s")], DOCS)
    for n in (quality.train(["a b"], ["!"], 0.5), quality.train([], ["a"], 0.1), quality.train(["a"], [], 0.9)):
        scores = [r["quality"] for r in quality.score(odd, n).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert quality.score(odd.limit(0), n).count() == 0


# Chat


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", "\\<|", "<\\|", "\\\\<\\\\|", "<|", "\\", "", None, "é\U0001f600<|x", "a\nb", "<\\/>", "x" * 50_000]
    roles = ["user", "assistant", "system", None, "a\nb", "<|im_end|>", "\\n", "<\\/>", "assistant"]
    rng = random.Random(7)
    rows = [(c if c else None, t, rng.choice(roles), rng.choice(texts), "extra") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, 1, "b", "same turn"), (99, 1, "a", "same turn"), (99, None, "assistant", "null turn")] and [(99, 1, "b", "same turn", ""), (99, 1, "a", "same turn", ""), (99, None, "assistant", "null turn", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns.withColumn("parts", chat_format.text_part(F.col("text"))))).collect()}
    escaped = lambda t: (t or "").replace("\\", "\\\\").replace("<|", "<\\|")
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", escaped(r[3]), r[3] or "") for r in rows if r[0] == c))
        assert [(t["role"], t["text"]) for t in found[c]["turns"]] == [(o[2], o[4]) for o in own]
        assert found[c]["loss_text"] == "".join(o[4] for o in own if o[2] == "assistant") and found[c]["n_turns"] == len(own)
    assert chat_format.format_chats(turns.limit(0).withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


def test_chat_parts_become_ordered_placeholders(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "a.png", 1024, 513, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3), ("video", "as text", "d", None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "done", None, None, None, None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(turns).collect()[0]
    assert r["formatted"] == "<|im_start|>user\nsee <\\|<|image|><|audio|><|document|>as text<|im_end|>\n<|im_start|>assistant\ndone<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", "a.png", 4 * 170), (0, "audio", "b.wav", 63), (0, "document", "c.pdf", 1800)] and r["expanded_tokens"] == 680 + 63 + 1800
    assert [r["formatted"][a:b] for a, b in zip(r["loss_starts"], r["loss_ends"])] == ["done"]


# Licences


def test_licences_by_digest(spark):
    mit = dict((n, t) for n, t in licence_scan.KNOWN if len(t) > 900 and n == "MIT")["MIT"]
    rows = [
        (1, "Copyright (c) 2001 A. Person\n\n" + mit.upper().replace("SOFTWARE", "SOFTWARE,"), "s"), (2, "words\nLICENCED under the Apache  Licence; version 2.0\nmore", "s"), (3, mit[:-20], "s"),
        (4, None, "s"), (5, "", "s"), (6, "before\n \n© 2020 x\n" + mit + "\n\nafter", "s"), (None, "Released under the MIT License.", "s"), (7, "Released under the MIT License.\nReleased under the MIT License.", "s"),
    ]
    found = {(r["doc_id"], r["licence"], r["unit"]): r["matches"] for r in licence_scan.licences(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {(1, "MIT", "text"): 1, (1, "MIT", "paragraph"): 1, (2, "Apache-2.0", "line"): 1, (6, "MIT", "paragraph"): 1, **{(None, "MIT", u): 1 for u in ("text", "paragraph", "line")}, (7, "MIT", "line"): 2}
    assert licence_scan.licences(spark.createDataFrame([], DOCS)).count() == 0


# Decontamination


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_against_the_full_matrix():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(0, 30))
        assert decontamination.align(a, b)[0] == brute_align(a, b)


def test_contaminated_against_aligning_everything(spark):
    rng = random.Random(8)
    items = [(i, fresh(rng, rng.randrange(15, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "Two Words"), (None, fresh(rng, 20))]
    docs = []
    for i in range(60):
        words = fresh(rng, rng.randrange(5, 200)).split()
        if i % 2:
            copy = [w for w in rng.choice(items[:12])[1].split()]
            for _ in range(rng.randrange(len(copy) // 4)):
                copy[rng.randrange(len(copy))] = "edited"
            if i % 3 == 0:
                copy.insert(5, "and more")
            words[3:3] = " ".join(copy).upper().replace(" ", ", ").split(" ")
        docs.append((i, " ".join(words), "s"))
    for k, (_, x) in enumerate(items[:12]):  # a word after every second one, every third one replaced, a part, every fourth one left out, parts apart
        own, around = x.split(), lambda n: fresh(rng, n).split()
        dense = [w for i, v in enumerate(own) for w in ([v, f"fill{i}"] if i % 2 else [v])]
        third = [f"other{i}" if i % 3 == 1 else v for i, v in enumerate(own)]
        some = own[k % 5 :][: -(-6 * len(own) // 10)]
        for j, copy in enumerate((dense, third, some, [v for i, v in enumerate(own) if i % 4], own[: len(own) // 2] + around(3) + own[len(own) // 2 :])):
            docs.append((200 + 10 * k + j, " ".join([*around(rng.randrange(60)), *copy, *around(rng.randrange(60))]), "s"))
    docs.append((400, "long " * 30_000 + items[3][1] + " long" * 500, "s"))
    docs += [(100, None, None), (101, "", None), (102, "here are two, words.", "s"), (None, items[0][1], "s"), (1, docs[1][1], "again")]
    of, seen = decontamination.words_of, {}
    number = lambda t: np.array([seen.setdefault(w, len(seen)) for w in of(t)], int)
    wanted = {}
    for d, t, _ in docs:
        for i, x in items:
            if of(x):
                score = decontamination.align(number(x), number(t))[0] / (2 * len(of(x)))
                if score >= decontamination.CONTAMINATED:
                    wanted.setdefault((d, i), []).append(round(score, 9))
    table = spark.createDataFrame(docs, DOCS)
    tests = spark.createDataFrame(items + items[:2], "item_id long, text string")
    assert sum(k[0] is not None and 200 <= k[0] < 400 for k in wanted) > 40
    found = {}
    for r in decontamination.contaminated(table, tests).collect():
        found.setdefault((r["doc_id"], r["item_id"]), []).append(round(r["score"], 9))
    assert found == wanted
    kept = [r["doc_id"] for r in decontamination.drop_contaminated(table, tests).collect()]
    assert sorted(map(str, kept)) == sorted(str(d[0]) for d in docs if not any(k[0] == d[0] for k in wanted))
    assert decontamination.contaminated(table, tests.limit(0)).count() == 0 and decontamination.contaminated(table.limit(0), tests).count() == 0
    assert decontamination.drop_contaminated(table, tests.limit(0)).count() == len(docs)


def test_quality_learns_the_same_from_repeats_and_double_labels(spark, monkeypatch):
    """An id with two labels is good, and of texts that share an id the least one is learnt, null as empty; so the order of rows is nothing."""
    from veriloom.llm import quality

    seen = []
    monkeypatch.setattr(quality, "train", lambda good, bad, rate: seen.append((good, bad, rate)))
    docs = [(1, "good b"), (1, "good a"), (1, "good b"), (2, "bad"), (3, "both"), (4, None), (4, "x"), (None, "none"), (5, "no label")]
    labels = [(1, 1), (2, 0), (2, 0), (3, 0), (3, 1), (4, 0), (None, 1), (5, None)]
    for turn in (1, -1):
        quality.fit(spark.createDataFrame(docs[::turn], "doc_id long, text string"), spark.createDataFrame(labels[::turn], "doc_id long, quality int"))
    assert seen[0] == (["good a", "both"], ["bad", ""], 0.5) and seen[1] == seen[0]
    quality.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert seen[2][:2] == ([], [])
