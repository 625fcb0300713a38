"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text compete for windows of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents of each class that are fitted on: the first ones by a hash of their id. All their text is used.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 1500, 4000
#: A window is a word, or so many characters of a longer one. It is compressed REPEATED times over, since a few bytes alone would be stored as they are.
WINDOW, REPEATED = 64, 4
#: Bytes of text in a training sample; bytes of the dictionaries and of their segments, for all windows and for those that seem toxic; length of what segments share.
SAMPLE, ALL, SEEMING, SHARED = 256, (32768, 32), (16384, 16), 8
#: Bytes saved from which a window seems toxic, and is judged by the second pair of dictionaries too.
SEEMS = 2
#: Thresholds on the bytes saved in a window, each with a calibrated weight.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8, 10)
#: Parts of the sample for the calibration; each is scored with dictionaries of the others. Windows that a task remembers.
PARTS, REMEMBERED = 3, 500_000
EDGES = " .,!?;:\n|%&*$#"


def windows_of(text: str | None) -> list[str]:
    """The windows of a whole text: its words in lower case without punctuation around them."""
    out = []
    for word in (text or "").lower().split():
        word = word.strip(EDGES)
        if len(word) <= WINDOW:
            if word:
                out.append(word)
        else:
            out += [word[i : i + WINDOW] for i in range(0, len(word), WINDOW)]
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content)
    tuned = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTULTRA,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held.precompute_compress(compression_params=tuned)
    return zstandard.ZstdCompressor(compression_params=tuned, dict_data=held)


def trained(texts: list[list[str]], size: int, segment: int) -> bytes:
    """A dictionary of texts, given as their windows; where they are too few for one of that size, a smaller one, at last their own text."""
    lines = [f" {' '.join(t)} ".encode() for t in texts if t]
    samples = [x[i : i + SAMPLE] for x in lines for i in range(0, len(x), SAMPLE)]
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=SHARED).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(lines)[-2048:].rjust(8, b" ")


class Pair:
    """Two dictionaries, of toxic and of ordinary text."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def saved(self, window: str) -> int:
        """Bytes by which the toxic dictionary makes a window shorter than the ordinary one does."""
        line = f" {window} ".encode() * REPEATED
        return len(self.ordinary(line)) - len(self.toxic(line))


@dataclass
class Model:
    """Plain values, so that it travels with a task: the dictionaries (toxic, ordinary) of all windows and of those that seem toxic, and the calibration."""

    all: tuple[bytes, bytes] = (b" " * 8, b" " * 8)
    seeming: tuple[bytes, bytes] = (b" " * 8, b" " * 8)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = -3.0


class Scorer(dict):
    """Holds what each window saves with both pairs of dictionaries, as one number; forgets when there are REMEMBERED of them."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.all, self.seeming = model, Pair(*model.all), Pair(*model.seeming)

    def __missing__(self, window: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        first = max(-999, min(999, self.all.saved(window)))
        second = max(-499, min(499, self.seeming.saved(window))) if first >= SEEMS else -500
        found = self[window] = first * 1000 + second
        return found

    def saved(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Of each window the bytes saved by the first pair, and by the second pair (-500 where the window doesn't seem toxic)."""
        windows = windows_of(text)
        packed = np.fromiter(map(self.__getitem__, windows), np.int64, len(windows)) + 500
        return packed // 1000, packed % 1000 - 500

    def features(self, text: str | None) -> np.ndarray:
        first, second = self.saved(text)
        both, n = np.where(second > -500, first + second, -999), max(1, len(first))
        counts = [np.array([(x >= t).sum() for t in some]) for x, some in ((both, THRESHOLDS), (second, THRESHOLDS[:6]), (first, THRESHOLDS[:5]))]
        return np.concatenate([[np.log1p(len(first)), first.sum() / n], *map(np.log1p, counts), counts[0] / n, counts[1] / n])

    def scores(self, texts) -> np.ndarray:
        m = self.model
        if not m.weights:
            return np.full(len(texts), 1 / (1 + np.exp(-m.bias)))
        x = (np.array([self.features(t) for t in texts], float).reshape(len(texts), -1) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights) + m.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = (z * (p * (1 - p) * share)[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(slope, z.T @ ((p - y) * share) + ridge * w), -5, 5)
    return w


def _dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> Model:
    """Two pairs of dictionaries. The first is trained on all text of each class. The second, on the windows of each class that seem toxic by a first pair
    of the other half of the sample: so it tells toxic windows from those of ordinary text that are mistaken for them."""
    halves = [(trained(toxic[i::2], *ALL), trained(ordinary[i::2], *ALL)) for i in (0, 1)]
    seeming: tuple[list, list] = ([], [])
    for i in (0, 1):
        pair, known = Pair(*halves[1 - i]), {}
        for texts, out in zip((toxic[i::2], ordinary[i::2]), seeming):
            for windows in texts:
                for w in windows:
                    if w not in known:
                        known[w] = pair.saved(w) >= SEEMS
                out.append([w for w in windows if known[w]])
    return Model((trained(toxic, *ALL), trained(ordinary, *ALL)), (trained(seeming[0], *SEEMING), trained(seeming[1], *SEEMING)))


def _windows(texts: list[str]) -> list[list[str]]:
    """The windows of each text; equal ones are one string, so a sample takes the memory of its distinct windows."""
    held: dict[str, str] = {}
    return [[held.setdefault(w, w) for w in windows_of(t)] for t in texts]


def _marked(toxic: list[str], ordinary: list[str], k: int) -> tuple[np.ndarray, list[int]]:
    """Features and classes of part k of the sample, by dictionaries of the other parts; none if the sample has no such part."""
    parts = min(PARTS, len(toxic), len(ordinary))
    if k >= parts:
        return np.zeros((0, 0)), []
    without = lambda texts: _windows([t for i, t in enumerate(texts) if i % parts != k] or texts)
    scorer = Scorer(_dictionaries(without(toxic), without(ordinary)))
    own, others = toxic[k::parts], ordinary[k::parts]
    return np.array([scorer.features(t) for t in own + others], float), [1] * len(own) + [0] * len(others)


def _calibrated(model: Model, x: np.ndarray, y: np.ndarray, toxic_rate: float) -> Model:
    model.mean, model.scale = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
    share = np.where(y == 1, toxic_rate / y.sum(), (1 - toxic_rate) / (len(y) - y.sum())) * len(y)
    *weights, bias = _logistic((x - model.mean) / model.scale, y, share, 1.0).tolist()
    model.weights, model.bias = weights, bias
    return model


def train(toxic: list[str], ordinary: list[str], toxic_rate: float) -> Model:
    """Dictionaries, and weights for the thresholds, calibrated at the true rate of toxic text on texts which the dictionaries have not seen. Repeated texts count once."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        return Model(bias=6.0 if toxic else -6.0)
    found = [(x, y) for x, y in (_marked(toxic, ordinary, k) for k in range(PARTS)) if y]
    return _calibrated(_dictionaries(_windows(toxic), _windows(ordinary)), np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), toxic_rate)


#: What a task gives back: the classes and features (flat) of a part of the sample, or the classes that the sample has and its dictionaries.
LEARNT = "part int, y array<int>, x array<double>, dictionaries array<binary>"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sample's rows (part, place, text, toxic), a copy for each part in a task of its own: one row of LEARNT. The last part is the whole sample."""
    rows = sorted((p, t, y, k) for b in batches for k, p, t, y in zip(*(b.column(c).to_pylist() for c in ("part", "place", "text", "toxic"))))
    if not rows:
        return
    part = rows[0][3]
    toxic, ordinary = (list(dict.fromkeys(t for _, t, y, _ in rows if y == own)) for own in (1, 0))
    rows.clear()
    x, y, content = np.zeros(0), [], []
    if part < PARTS:
        x, y = _marked(toxic, ordinary, part)
    else:
        y = [1] * bool(toxic) + [0] * bool(ordinary)
        if len(y) == 2:
            model = _dictionaries(_windows(toxic), _windows(ordinary))
            content = [*model.all, *model.seeming]
    columns = [part], [y], [x.ravel().tolist()], [content]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.binary())))], ["part", "y", "x", "dictionaries"])


def sampled(labels: DataFrame, n: int) -> DataFrame:
    """The first n of the rows (doc_id, ...) by a hash of the id; all, if there are no more."""
    return labels.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels (doc_id, toxic), as train() does. Dictionaries are trained and texts read in tasks, one for each part of the sample and one for
    the whole; only the dictionaries and the features reach the driver. At most TOXIC_SAMPLE and ORDINARY_SAMPLE of the labelled documents are the sample.

    Ids may be of any type. Rows with a null id or label are left out; an id with two labels is toxic; of documents that repeat an id the least
    text counts, null as empty. Without documents of one of the classes all texts score alike.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    toxic, ordinary = labels.where("toxic = 1"), labels.where("toxic = 0")
    rate = toxic.count() / max(1, labels.count())
    ids = sampled(toxic, TOXIC_SAMPLE).union(sampled(ordinary, ORDINARY_SAMPLE)).withColumn("place", F.xxhash64("doc_id"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = texts.groupBy("place", "doc_id", "toxic").agg(F.min("text").alias("text"))
    copies = rows.select(F.explode(F.sequence(F.lit(0), F.lit(PARTS))).alias("part"), "place", "text", "toxic")
    *parts, whole = sorted(copies.repartitionById(PARTS + 1, F.col("part")).mapInArrow(_learn, LEARNT).collect(), key=lambda r: r["part"]) or [None]
    if whole is None or len(whole["y"]) < 2:
        return Model(bias=6.0 if whole and whole["y"] == [1] else -6.0)
    y = [np.array(r["y"]) for r in parts if r["y"]]
    x = [np.array(r["x"]).reshape(len(r["y"]), -1) for r in parts if r["y"]]
    a, b, c, d = map(bytes, whole["dictionaries"])
    return _calibrated(Model((a, b), (c, d)), np.concatenate(x), np.concatenate(y), min(0.9, max(0.01, rate)))


def score_column(model: Model):
    held = []

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(model))
        return pa.array(held[0].scores(texts.to_pylist()), pa.float64())

    return toxicity


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of docs, with toxicity, from 0 to 1. Null and empty texts have a score like any other; a column toxicity is replaced."""
    return docs.withColumn("toxicity", score_column(model)("text"))


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows that score below the limit, with the columns of docs, which may have any names. Null and empty texts are scored like others; repeated rows score alike."""
    return docs.withColumn("_toxicity", score_column(model)("text")).where(F.col("_toxicity") < limit).drop("_toxicity")
