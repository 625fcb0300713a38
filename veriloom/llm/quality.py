"""Quality by a byte-level convolutional network in numpy: filters over overlapping chunks of the whole document, max-pooled."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import sampled

#: Most labelled documents of each class that are fitted on, and most chunks of one of them that are.
SAMPLE, TRAINED_CHUNKS = 1500, 24
#: Bytes of a chunk, of the step from one to the next, and of a filter; filters; hidden units; passes over the sample.
CHUNK, STEP, WIDTH = 256, 128, 4
FILTERS, HIDDEN, EPOCHS, BATCH, RATE = 16, 16, 14, 32, 0.01
#: Bytes that are filtered at once.
BLOCK = 32_768


@dataclass
class Network:
    """filters: (WIDTH, 256, FILTERS) weights of the bytes a filter sees; chunks' pooled filters and their log length go through one hidden layer to a
    number; a document's probability comes from the largest, the least and the mean of its chunks' numbers."""

    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    combine: np.ndarray

    def __post_init__(self):
        self.pairs = None

    def __getstate__(self):
        return self.__dict__ | {"pairs": None}

    def pooled(self, data: bytes) -> np.ndarray:
        """Largest response of each filter in each chunk. Two bytes are looked up at once, in tables made from the filters."""
        if self.pairs is None:
            f = self.filters.astype(np.float32)
            self.pairs = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]
        x = np.frombuffer(data + bytes(max(0, WIDTH - len(data))), np.uint8)
        two = x[:-1].astype(np.uint16) * np.uint16(256) + x[1:]
        n = len(x) - WIDTH + 1
        steps = -(-n // STEP)
        most = np.full((steps, FILTERS), -np.inf, np.float32)
        for at in range(0, n, BLOCK):
            end = min(n, at + BLOCK)
            seen = self.pairs[0][two[at:end]]
            for k in range(1, WIDTH // 2):
                seen += self.pairs[k][two[at + 2 * k : end + 2 * k]]
            most[at // STEP : -(-end // STEP)] = np.maximum.reduceat(seen, np.arange(0, end - at, STEP))
        return np.maximum(most[:-1], most[1:]) if steps > 1 else most

    def chunk_numbers(self, pooled: np.ndarray, length: int) -> np.ndarray:
        x = np.concatenate([np.maximum(pooled + self.bias, 0), np.full((len(pooled), 1), np.log1p(min(length, CHUNK)) / 6)], axis=1)
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out

    def score(self, text: str | None) -> float:
        data = (text or "").encode()
        v = self.chunk_numbers(self.pooled(data), len(data))
        z = self.combine @ np.array([v.max(), v.min(), v.mean(), 1.0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def scores(self, texts) -> np.ndarray:
        return np.array([self.score(t) for t in texts], float)


def _chunks(text: str, rng) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the length and step that scoring uses (of a long document, some), and how many places a filter has in each."""
    data = text.encode()
    length = CHUNK + WIDTH - 1
    x = np.zeros(max(length, STEP * max(0, -(-(len(data) - WIDTH + 1 - CHUNK) // STEP)) + length), np.int64)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    starts = np.arange(0, len(x) - length + 1, STEP)
    if len(starts) > TRAINED_CHUNKS:
        starts = np.sort(rng.choice(starts, TRAINED_CHUNKS, replace=False))
    places = np.clip(max(len(data), WIDTH) - WIDTH + 1 - starts, 1, CHUNK)
    return x[starts[:, None] + np.arange(length)], places


def train(good: list[str], bad: list[str], good_rate: float, seed: int = 7) -> Network:
    """Adam on the logistic loss of documents, each class weighted to its true rate."""
    rng = np.random.default_rng(seed)
    p = {
        "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), "bias": np.zeros(FILTERS), "hidden": rng.normal(0, 0.35, (FILTERS + 1, HIDDEN)),
        "hidden_bias": np.full(HIDDEN, 0.1), "out": rng.normal(0, 0.35, HIDDEN), "combine": np.array([0.2, 0.6, 0.4, 0.0]),
    }
    if not good or not bad:
        return Network(*[p[k] * 0 if k == "combine" else p[k] for k in p][:-1], combine=np.array([0, 0, 0, 6.0 if good else -6.0]))
    docs = [(*_chunks(t, rng), len(t.encode()), y) for y, ts in ((1.0, good), (0.0, bad)) for t in ts]
    odds = good_rate / (1 - good_rate)
    share = {1.0: odds / (1 + odds) * len(docs) / len(good), 0.0: 1 / (1 + odds) * len(docs) / len(bad)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            batch = [docs[i] for i in order[at : at + BATCH]]
            x, places = np.concatenate([d[0] for d in batch]), np.concatenate([d[1] for d in batch])
            ends = np.cumsum([len(d[0]) for d in batch])
            starts = ends - [len(d[0]) for d in batch]
            length = np.repeat([np.log1p(min(d[2], CHUNK)) / 6 for d in batch], ends - starts)
            f = p["filters"].astype(np.float32)
            seen = f[0][x[:, :CHUNK]]
            for k in range(1, WIDTH):
                seen += f[k][x[:, k : k + CHUNK]]
            seen[np.arange(CHUNK) >= places[:, None]] = -np.inf
            where = seen.argmax(axis=1)
            pooled = np.take_along_axis(seen, where[:, None, :], axis=1)[:, 0, :].astype(float)
            a = np.concatenate([np.maximum(pooled + p["bias"], 0), length[:, None]], axis=1)
            h = np.maximum(a @ p["hidden"] + p["hidden_bias"], 0)
            c = h @ p["out"]
            g = {k: np.zeros_like(z) for k, z in p.items()}
            dc = np.zeros_like(c)
            for (_, _, _, y), i, j in zip(batch, starts, ends):
                own = c[i:j]
                s = np.array([own.max(), own.min(), own.mean(), 1.0])
                d = (1 / (1 + np.exp(-np.clip(p["combine"] @ s, -30, 30))) - y) * share[y] / len(batch)
                g["combine"] += d * s
                dc[i + own.argmax()] += d * p["combine"][0]
                dc[i + own.argmin()] += d * p["combine"][1]
                dc[i:j] += d * p["combine"][2] / (j - i)
            g["out"] = h.T @ dc
            dh = np.outer(dc, p["out"]) * (h > 0)
            g["hidden"], g["hidden_bias"] = a.T @ dh, dh.sum(axis=0)
            da = (dh @ p["hidden"].T)[:, :FILTERS] * (pooled + p["bias"] > 0)
            g["bias"] = da.sum(axis=0)
            columns = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(g["filters"][k], (np.take_along_axis(x, where + k, axis=1), columns), da)
            step += 1
            rate = RATE * (0.3 if epoch >= EPOCHS * 2 // 3 else 1)
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Network(**p)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """labels: rows (doc_id, quality) to learn from. At most SAMPLE documents of each class are read to the driver.

    Rows with a null id or label are left out; an id with two labels is good; of documents that repeat an id the least text
    counts, null as empty. Empty tables, or labels without documents, give a network that scores all texts alike.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    good, bad = labels.where("quality = 1"), labels.where("quality = 0")
    rate = good.count() / max(1, labels.count())
    ids = sampled(good, SAMPLE).union(sampled(bad, SAMPLE))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows if r["quality"]], [r["text"] for r in rows if not r["quality"]], min(0.95, max(0.05, rate)))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """All rows and columns of docs, with quality, from 0 to 1. Null and empty texts have a score like any other; a column quality is replaced."""

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(network.scores(texts.to_pylist()), pa.float64())

    return docs.withColumn("quality", quality("text"))
