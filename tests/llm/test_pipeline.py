"""The pipeline against a brute-force version of each stage, and its handling of odd tables."""

import random
from collections import defaultdict

import pytest
from test_dedup_and_mixing import ascii_lower, brute_targets
from test_text_operators import brute_align, toxic_corpus

import __spark_entry__
import corpus_pipeline
from veriloom.llm import decontamination, toxicity
from veriloom.llm.queries import toxicity_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t)) for i, t, _ in toxic_corpus(rng, 260)]
    labels = [(i, 1, y) for i, _, y in toxic_corpus(random.Random(21), 260) if i % 3]
    items = [(k, " ".join("".join(rng.choice("pqxz") for _ in range(6)) for _ in range(25))) for k in range(5)]
    clean = [r for r in rows if r[0] % 4 and len(r[1].split()) >= 120]
    extra, n = [], 1000
    for r in clean[:25]:
        extra.append((n, r[1].upper(), "en", "copies", 1))
        words = r[1].split()
        words[len(words) // 2] = "changed"
        extra.append((n + 1, " ".join(words), "en", "near", 1))
        n += 2
    for k, r in enumerate(clean[40:52]):
        words = r[1].split()
        extra.append((n, " ".join(words[:5] + items[k % 5][1].split()[: 25 - k % 3] + words[5:]), "en", "leak", 1))
        n += 1
    extra += [(n, None, None, None, None), (n + 1, "", "en", "x", 0), (n + 2, " \n", "en", "x", 2), (None, "a text without an id that stands alone in here", "en", "x", 3)]
    spark.createDataFrame(rows + extra, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def shingles(text):
    w = ascii_lower(text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_near(docs):
    """The smallest id of each group that similarities of 0.8 connect."""
    sets, top = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    groups = defaultdict(list)
    for (i, _), t in zip(docs, top):
        groups[t].append(i)
    return {min((i for i in g if i is not None), default=None) for g in groups.values()}


def test_pipeline_against_brute_force(spark, sf_dir):
    model = toxicity_model(spark, sf_dir)
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    scorer = toxicity.Scorer(model)
    docs = [d for d, s in zip(docs, scorer.scores([d[1] for d in docs])) if s < 0.5]
    best = {}
    for d in docs:
        key = ascii_lower(d[1])
        best[key] = max([best.get(key, (-1,))[0], -1 if d[0] is None else d[0]]), d
    docs = [d for d in docs if (-1 if d[0] is None else d[0]) == best[ascii_lower(d[1])][0]]
    near = brute_near([(d[0], d[1]) for d in docs])
    docs = [d for d in docs if d[0] in near]
    of = decontamination.words_of
    docs = [d for d in docs if not any(brute_align(of(x), of(d[1])) >= len(of(x)) for x in items)]
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[2]] += len((d[1] or "").encode().split())
    targets = brute_targets(dict(sizes))
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(d[0]) for d in docs)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] <= 3 * r["size"]


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.dtypes == [(x.split()[0], {"long": "bigint"}.get(x.split()[1], x.split()[1])) for x in DOCS.split(", ")]


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_all_ten_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
