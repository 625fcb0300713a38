"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, linked by Hamming distance with BK-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, components, joinable

#: Fingerprints in one BK-tree; larger buckets are split into several trees.
TREE_SIZE = 4096
#: Fingerprints that a bucket should hold on average.
BUCKET_MEAN = 48
#: Bits of a wide fingerprint. Texts whose sets of shingles are 0.8 alike differ in about FLIPPED of them; WIDE_RADIUS bits are allowed.
#: These only propose links (see verified_links), so they decide how much is left to the exact search, not what is found.
WIDE, FLIPPED, WIDE_RADIUS, RECALL = 512, 0.15, 88, 0.98
#: Shingles that COMMON or more of about SAMPLED documents hold come last in the order of the exact search, the MOST_COMMON of them at most.
SAMPLED, COMMON, MOST_COMMON = 6_000, 3, 20_000
#: Words whose hashes, and sets of shingles that it has met, a task remembers.
REMEMBERED = 500_000
#: Shingles that a batch of the exact count holds.
BATCH_SHINGLES = 100_000
#: Rows of a shingle up to which its documents are compared before they count as candidates; above, all are candidates.
COMPARED = 2048


def fingerprint(text: str | None, shingle: int, parts: int = 0) -> bytes:
    """64 bits, or 128 a part. Lower-cases A-Z and splits at ASCII blanks. A bit is set if more than half of the shingles' hashes have it; no words: 0.

    The hash is XXH64 with seed 42 for 64 bits; for more it is XXH3-128, with seed 42 for the first part, 43 for the next, and so on.
    """
    words = (text or "").encode().lower().split()
    digest, width = (xxhash.xxh3_128_digest, 16) if parts else (xxhash.xxh64_digest, 8)
    if not words:
        return bytes(width * (parts or 1))
    line = b" ".join(words)
    if len(words) <= shingle:
        shingles = [line]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        shingles = [line[i:j] for i, j in zip((ends - lengths).tolist(), ends[shingle - 1 :].tolist())]
    out = []
    for seed in range(42, 42 + (parts or 1)):
        rows = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8).reshape(-1, width)
        votes = np.zeros(8 * width, np.int64)
        for at in range(0, len(rows), 65536):
            votes += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * votes > len(rows)).tobytes())
    return b"".join(out)


def fingerprint_column(shingle: int, parts: int = 0):
    """long for 64 bits, binary for parts."""

    @F.arrow_udf("binary" if parts else "long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, shingle, parts) for t in texts.to_pylist()]
        return pa.array(found, pa.binary()) if parts else pa.array(np.frombuffer(b"".join(found), ">u8").astype(np.uint64).view(np.int64))

    return simhash


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        node = self.root
        if node is None:
            self.root = (value, {})
            return
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Follows only the edges whose distance can lead into the radius."""
        stack = [self.root] if self.root else []
        while stack:
            held, children = stack.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                yield held
            if children:
                stack += [c for k, c in children.items() if d - radius <= k <= d + radius]


def _links_of_shard(own: list[int], others: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within own, or between own and others where others are given: fewer links than members."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    tree, out = BKTree(), []

    def join(value: int) -> None:
        for near in tree.within(value, radius):
            a, b = top(near), top(value)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((near, value))

    for value in own:
        if not others:
            join(value)
        tree.add(value)
    for value in others:
        join(value)
    return out


def _links(radius: int, wide: bool):
    read = (lambda column: [int.from_bytes(x, "big") for x in column.to_pylist()]) if wide else (lambda column: column.to_numpy().view(np.uint64).tolist())

    def written(values):
        return pa.array([v.to_bytes(WIDE // 8, "big") for v in values], pa.binary()) if wide else pa.array(np.array(values, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by shard; one shard is held at a time."""
        key, own, others, out = None, [], [], []

        def flush():
            if len(own) + len(others) > 1:
                out.extend(_links_of_shard(own, others, radius))
            own.clear()
            others.clear()

        def drained():
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([written(a), written(b)], ["a", "b"])

        for batch in batches:
            for shard, value, side in zip(batch.column("shard").to_pylist(), read(batch.column("fp")), batch.column("side").to_pylist()):
                if shard != key:
                    flush()
                    key = shard
                (others if side else own).append(value)
            if out:
                yield drained()
        flush()
        if out:
            yield drained()

    return run


def block_masks(n: int, radius: int) -> list[int]:
    """Bit masks of which two values within the radius agree on one at least: 64 bits cut into radius + k blocks, any k of them.

    k grows until n random values spread to about BUCKET_MEAN a mask's value.
    """
    for k in range(1, 5):
        blocks = radius + k
        edges = [64 * i // blocks for i in range(blocks + 1)]
        if k == 4 or n / 2 ** (64 * k / blocks) <= BUCKET_MEAN:
            bits = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
            return [sum(c) for c in combinations(bits, k)]
    raise AssertionError


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def sampled_bits(n: int) -> list[np.ndarray]:
    """Tables of bit places of a wide fingerprint, from a fixed seed: enough that two documents which differ in FLIPPED of the bits agree in all
    places of one table with probability RECALL. A table has as many places as spread n random values to BUCKET_MEAN a bucket."""
    k = max(6, math.ceil(math.log2(max(n, 1) / BUCKET_MEAN + 1)))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - FLIPPED) ** k))
    rng = np.random.default_rng(12345)
    return [rng.choice(WIDE, k, replace=False) for _ in range(tables)]


def _place(tables: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("fp")
            bits = np.unpackbits(np.frombuffer(b"".join(held.to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1)
            for i, places in enumerate(tables):
                own = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([held, pa.array((np.int64(i) << np.int64(48)) + own)], ["fp", "bucket"])

    return run


def linked(fingerprints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) whose distance is within the radius; not all pairs.

    64-bit fingerprints are placed in buckets by all masks of block_masks, so no link is lost; wide ones by sampled_bits, which
    lose few (RECALL). Buckets are the shards of the search, each with its own BK-tree. A bucket over TREE_SIZE is dealt out
    to several trees, and each of its fingerprints is sent to all trees of its own bucket.
    """
    n = fingerprints.count()
    wide = dict(fingerprints.dtypes)["fp"] == "binary"
    if wide:
        placed = fingerprints.mapInArrow(_place(sampled_bits(n)), "fp binary, bucket long")
    else:
        each = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for i, m in enumerate(block_masks(n, radius))]))
        placed = fingerprints.select("fp", each.alias("e")).select("fp", F.xxhash64("e.m", "e.v").alias("bucket"))
    big = placed.groupBy("bucket").count().where(F.col("count") > TREE_SIZE).select("bucket", F.ceil(2 * F.col("count") / TREE_SIZE).cast("int").alias("trees"))
    placed = placed.join(joinable(checkpointed(big)), "bucket", "left")
    small = placed.where("trees is null").select(F.col("bucket").alias("shard"), "fp", F.lit(0).alias("side"))
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    sent = placed.where("trees is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    split = sent.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    dealt = small.union(split).repartition("shard").sortWithinPartitions("shard", "side", "fp")
    kind = "binary" if wide else "long"
    return dealt.mapInArrow(_links(radius, wide), f"a {kind}, b {kind}")


def group_near_copies(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """All rows and columns of docs (doc_id, text, ...), with fingerprint, component_id and _tops.

    fingerprint: 16 hex digits. component_id: the smallest doc_id that links of at most radius differing bits reach.
    Null and blank texts have fingerprint zero and link like others. Rows with a null id are grouped like others and give
    no component_id of their own. _tops counts the rows that carry component_id. Columns of docs with these names are
    replaced; an empty table gives no rows.
    """
    docs = docs.drop("fingerprint", "component_id", "_tops", "_fp")
    marked = docs.withColumn("_fp", fingerprint_column(shingle)("text"))
    return labelled(marked, radius)


def labelled(marked: DataFrame, radius: int, links: DataFrame | None = None) -> DataFrame:
    """Links of the fingerprints within the radius, where none are given."""
    reps = checkpointed(marked.groupBy("_fp", "doc_id").agg(F.count("*").alias("n")).groupBy("_fp").agg(F.min("doc_id").alias("doc"), F.min_by("n", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("tops")).withColumnRenamed("_fp", "fp"))
    roots = components(linked(reps.select("fp"), radius) if links is None else links)
    inside = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "doc", "tops", F.coalesce("root", "fp").alias("root"))
    best = F.min(F.struct(F.col("doc").isNull().alias("x"), "doc", "tops")).alias("best")
    # Checkpointed, so that the join below reads both sides from plain shuffles and Spark can split a large group's.
    names = checkpointed(inside.groupBy("root", "doc").agg(F.sum("tops").alias("tops")).groupBy("root").agg(best).select("root", F.col("best.doc").alias("component_id"), F.col("best.tops").alias("_tops")))
    labels = inside.join(names, "root").select(F.col("fp").alias("_fp"), "component_id", "_tops", F.col("root").alias("_root"))
    return marked.join(labels, "_fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0"))).drop("_fp")


class _Hashes(dict):
    """Hashes of words; forgotten when there are REMEMBERED of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_hashes(text: str | None, shingle: int, hashes: _Hashes | None = None) -> np.ndarray:
    """The set of a text's shingles as ascending 64-bit hashes. Fewer words than a shingle are one shingle; no words, none."""
    words = (text or "").encode().lower().split()
    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    hashes = _Hashes() if hashes is None else hashes
    own, n = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), len(words) - k + 1
    codes = np.full(n, k, np.uint64)
    for i in range(k):
        codes = (codes ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(29)
    return np.unique(codes)


def signature(held: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of 2^k classes, by the lowest k bits; two to four in a class on average. Empty if a class has over 255."""
    classes = 1 << max(0, len(held).bit_length() - 2)
    counts = np.bincount((held & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def cannot_be_alike(x: bytes, y: bytes) -> bool:
    """Whether the signatures show that two sets are less than 4/5 alike: they share at most the lesser count of each class."""
    if not x or not y:
        return False
    a, b = sorted((np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y)), key=len)
    b = b.reshape(-1, len(a)).sum(axis=0)
    both = int(np.minimum(a, b).sum())
    return 5 * both < 4 * (int(a.sum()) + int(b.sum()) - both)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 4/5 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Frequent shingles of a sample, the most frequent first. They only order the exact search; its result is the same with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = [shingle_hashes(t, shingle, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    share = max(1, docs.count() // SAMPLED)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").mapInArrow(run, "h long")
    rows = sample.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64)


def _prefixes(shingle: int, common: np.ndarray):
    """Adds to rows (doc_id, _text, text): _fp, the hash of the set of shingles, its size n, and the first of its shingles in the order of the search.

    Two sets that are 4/5 alike share one at least of their first n - ceil(4n/5) + 1 shingles, in any order of all shingles. A task gives them
    once for a set that it meets again, so that a large group of copies does not crowd the shingles' tasks.
    """
    order = np.argsort(common)
    known, rank = common[order], len(common) - order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met, nothing = _Hashes(), set(), np.zeros(0, np.int64)
        for batch in batches:
            ids, sizes, firsts = [], [], []
            for text in batch.column("text").to_pylist():
                held = shingle_hashes(text, shingle, hashes)
                n, own = len(held), xxhash.xxh3_64_intdigest(held.tobytes())
                ids.append(own)
                sizes.append(n)
                if not n or own in met:
                    firsts.append(nothing)
                    continue
                if len(met) >= REMEMBERED:
                    met.clear()
                met.add(own)
                if len(known):
                    at = np.minimum(np.searchsorted(known, held), len(known) - 1)
                    held = held[np.argsort(np.where(known[at] == held, rank[at], 0), kind="stable")]
                firsts.append(held[: n - (4 * n + 4) // 5 + 1].view(np.int64))
            ends = np.cumsum([0, *map(len, firsts)])
            first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([nothing, *firsts])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), first], ["doc_id", "_text", "_fp", "n", "first"])

    return run


def _each_shingle(batches: Iterator[pa.RecordBatch], found) -> Iterator[list[np.ndarray]]:
    """Rows are sorted by their first column, h. Calls found with the columns of each h that two rows or more have; gives what it returns, batch by batch."""
    rest = None

    def of(rows: list[np.ndarray], edges: np.ndarray) -> list[np.ndarray] | None:
        out = [y for k in np.flatnonzero(np.diff(edges) > 1) for y in found([c[edges[k] : edges[k + 1]] for c in rows])]
        return [np.concatenate(c) for c in zip(*out)] if out else None

    for batch in batches:
        new = [c.to_numpy() for c in batch.columns]
        rows = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
        if not len(rows[0]):
            continue
        edges = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
        if out := of(rows, edges):
            yield out
        rest = [c[edges[-1] :] for c in rows]
    if rest is not None and (out := of(rest, np.array([0, len(rest[0])]))):
        yield out


def _may_be_alike(n: np.ndarray, at: np.ndarray, some: slice) -> np.ndarray:
    """Which of some rows (sizes n, places at of a shared shingle) can be 4/5 alike to which row, if this is the first shingle that they share."""
    n, left = n.astype(np.int64), n.astype(np.int64) - at
    sizes = 5 * np.minimum(n[some, None], n) >= 4 * np.maximum(n[some, None], n)
    return sizes & (9 * np.minimum(left[some, None], left) >= 4 * (n[some, None] + n))


def _blocks(rows: int) -> Iterator[slice]:
    return (slice(i, min(rows, i + 256)) for i in range(0, rows, 256))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, _fp, n, at) sorted by h and _fp those that may be alike to another row of their h; each set once."""

    def found(rows):
        rows = [c[np.append(True, np.diff(rows[1]) != 0)] for c in rows]
        if len(rows[0]) > COMPARED:
            return [rows]
        kept = np.concatenate([(_may_be_alike(rows[2], rows[3], some) & (rows[1][some, None] != rows[1])).any(axis=1) for some in _blocks(len(rows[0]))])
        return [[c[kept] for c in rows]] if kept.any() else []

    for columns in _each_shingle(batches, found):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "_fp", "n", "at"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, _fp, n, at, root) sorted by h the pairs of one h and two roots that may be alike."""

    def found(rows):
        _, fp, n, at, root = rows
        if (root == root[0]).all():
            return
        for some in _blocks(len(fp)):
            i, j = np.nonzero(_may_be_alike(n, at, some) & (root[some, None] != root) & (fp[some, None] < fp))
            if len(i):
                yield [fp[some][i], fp[j]]

    for columns in _each_shingle(batches, found):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])


def _marks(shingle: int):
    """Rows (_fp, wide, sig) of rows (_fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            wide = [fingerprint(t, shingle, WIDE // 128) for t in texts]
            sig = [signature(shingle_hashes(t, shingle, hashes)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("_fp"), pa.array(wide, pa.binary()), pa.array(sig, pa.binary())], ["_fp", "wide", "sig"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            held = [shingle_hashes(t, shingle, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_fp"), pa.array(held, pa.binary())], ["_fp", "held"])

    return run


def _each_set(shingle: int):
    """Rows (h, _fp, n) of rows (_fp, text): each shingle of a set, with the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, fps, sets, held = _Hashes(), [], [], 0

        def drained():
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            columns = np.concatenate(sets).view(np.int64), np.repeat(np.array(fps, np.int64), sizes), np.repeat(sizes.astype(np.int32), sizes)
            fps.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "_fp", "n"])

        for batch in batches:
            for fp, text in zip(batch.column("_fp").to_pylist(), batch.column("text").to_pylist()):
                fps.append(fp)
                sets.append(shingle_hashes(text, shingle, hashes))
                held += len(sets[-1])
                if held >= BATCH_SHINGLES:
                    yield drained()
                    held = 0
        if sets:
            yield drained()

    return run


def rarest_first(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (h, _fp, n, at): the first shingles of the sets of texts (_fp, text) in the order of how many of these sets hold them, the rarest first.

    Shingles that no other set holds come first and meet nothing, so they have no row; a set that has n - ceil(4n/5) + 1 of them has none at all. A passage
    that ever more documents quote then brings together only sets that have little else of their own.
    """
    every = texts.mapInArrow(_each_set(shingle), "h long, _fp long, n int")
    met = every.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    own = Window.partitionBy("_fp")
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h")) - 1
    return met.withColumn("at", at.cast("int")).where("at <= n - ceil(4 * n / 5)").select("h", "_fp", "n", "at")


def _pairs_kept(kept):
    """Of rows (a, b, x, y) the pairs (a, b) for which kept(x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [kept(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    first, second = held.select(F.col("_fp").alias("a"), F.col(column).alias("x")), held.select(F.col("_fp").alias("b"), F.col(column).alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")


class _Texts:
    """The texts of sets of shingles: of each the rows with one id and text, by which they are read from docs again."""

    def __init__(self, docs: DataFrame, marked: DataFrame):
        self.docs, self.marked = docs, marked
        self.repeat = not marked.groupBy("doc_id", "_text").count().where("count > 1").isEmpty()

    def of(self, sets: DataFrame) -> DataFrame:
        """Rows (_fp, text) of distinct sets (column _fp). Docs are shuffled only if the sets are too many for a broadcast."""
        one = self.marked.join(sets, "_fp").groupBy("_fp").agg(F.min(F.struct("doc_id", "_text")).alias("one"))
        keys = joinable(checkpointed(one.select("_fp", F.col("one.doc_id").alias("_id"), F.col("one._text").alias("_own"))))
        found = self.docs.select("doc_id", _digest().alias("_text"), "text")
        found = found.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_own"))).select("_fp", "text")
        return found.dropDuplicates(["_fp"]) if self.repeat else found


def verified(pairs: DataFrame, marks: DataFrame, texts: _Texts, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are 4/5 alike. Only texts of pairs that their signatures (marks) do not rule out are read."""
    rest = checkpointed(_with_both(pairs, marks, "sig").mapInArrow(_pairs_kept(lambda x, y: not cannot_be_alike(x, y)), "a long, b long"))
    sets = texts.of(rest.select(F.col("a").alias("_fp")).union(rest.select("b")).distinct()).mapInArrow(_sets(shingle), "_fp long, held binary")
    same = lambda x, y: alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
    return _with_both(rest, sets, "held").mapInArrow(_pairs_kept(same), "a long, b long")


def verified_links(docs: DataFrame, marked: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Links (a, b) between sets of shingles (_fp) that connect all that are 4/5 alike, and only such links.

    First the documents go that share none of their first shingles with another one of fitting size: nothing is alike to them.
    The shingles of the others are counted, and of their first ones by these counts (rarest_first) the same is asked again. Among the others SimHash proposes links, which are verified on the sets. Then all pairs that still are in two components, share
    one of their first shingles and may be alike are verified too; so what SimHash misses is found.
    """
    places = marked.select("_fp", "n", F.posexplode("first").alias("at", "h")).select("h", "_fp", "n", "at")
    texts = _Texts(docs, marked.select("doc_id", "_text", "_fp"))

    def candidates(places: DataFrame) -> DataFrame:
        return checkpointed(places.repartition("h").sortWithinPartitions("h", "_fp").mapInArrow(_candidates, "h long, _fp long, n int, at int"))

    shared = candidates(rarest_first(texts.of(candidates(places).select("_fp").distinct()), shingle))
    marks = checkpointed(texts.of(shared.select("_fp").distinct()).mapInArrow(_marks(shingle), "_fp long, wide binary, sig binary"))
    reps = checkpointed(marks.groupBy("wide").agg(F.min("_fp").alias("one")))
    near = linked(reps.select(F.col("wide").alias("fp")), radius)
    near = near.join(reps.select(F.col("wide").alias("a"), F.col("one").alias("x")), "a").join(reps.select(F.col("wide").alias("b"), F.col("one").alias("y")), "b")
    equal = marks.select("_fp", "wide").join(reps, "wide").where("_fp <> one").select("one", "_fp")
    links = checkpointed(verified(near.select(F.col("x").alias("a"), F.col("y").alias("b")).union(equal).distinct(), marks, texts, shingle))
    roots = components(links)
    rest = shared.join(roots, shared["_fp"] == roots["node"], "left").select("h", "_fp", "n", "at", F.coalesce("root", "_fp").alias("root"))
    pairs = rest.repartition("h").sortWithinPartitions("h").mapInArrow(_pairs, "a long, b long").distinct()
    return links.union(verified(pairs, marks, texts, shingle))


def _digest() -> F.Column:
    """128 bits of a text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def near_dedup(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id, with the columns of docs (doc_id, text, ...).

    Near copies are connected by links between texts whose sets of shingles have a Jaccard similarity of 0.8 or more, all of them
    and no others (as far as 64-bit hashes of shingles and sets tell them apart); see verified_links. Texts of fewer words than
    a shingle are one shingle; null, empty and blank texts are alike. A null doc_id counts as the largest; rows of a group that all lack an
    id leave one row too. Of rows that repeat the smallest id of their group, the one with the least digest of its text stays, and of
    equal texts among these any one. Other columns are kept whatever their names. An empty table gives no rows.
    """
    text = _digest()
    added = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _text binary, _fp long, n int, first array<long>"
    own = docs.select("doc_id", text.alias("_text"), "text")
    marked = checkpointed(own.mapInArrow(_prefixes(shingle, common_shingles(docs, shingle)), added))
    rows = labelled(marked.select("doc_id", "_text", "_fp"), radius, verified_links(docs, marked, shingle, radius))
    rows = checkpointed(rows.select("doc_id", "_text", "component_id", "_tops", "_root"))
    best = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ties = rows.where(best & (F.col("_tops") > 1)).groupBy("_root").agg(F.min(F.struct(F.col("doc_id"), F.col("_text"))).alias("one"))
    tied = not ties.isEmpty()
    gone = rows.where(~best).select("doc_id", "_text")
    if tied:
        gone = gone.union(rows.where(best & (F.col("_tops") > 1)).join(ties, "_root").where("_text <> one._text").select("doc_id", "_text"))
    gone = joinable(checkpointed(gone.distinct().select(F.col("doc_id").alias("_id"), F.col("_text").alias("_gone"))))
    there = F.col("doc_id").eqNullSafe(F.col("_id")) & (text == F.col("_gone"))
    left = docs.join(gone, there, "left_anti")
    if not tied:
        return left
    ties = joinable(checkpointed(ties.select(F.col("one.doc_id").alias("_id"), F.col("one._text").alias("_gone"))))
    again = left.join(ties, there, "left_semi").withColumn("_text", text).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return left.join(ties, there, "left_anti").unionByName(again)
