"""Substring de-duplication: suffixes are dealt out by prefixes of variable length; each group's suffix tree tells which are repeated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Words of a repeat; words of the short prefix that suffixes are dealt out by.
WINDOW, PREFIX = 35, 12
#: Bytes of suffixes that one group may hold; the prefix of a larger group is lengthened, by a third of what is left of the window at a time.
GROUP_BYTES = 64_000_000
#: What a suffix costs beside its words.
OVERHEAD = 100
#: Codes beyond this share of all places are joined by broadcast.
HOT_SHARE = 2_000
#: Distinct words whose hashes a task remembers.
REMEMBERED = 500_000
#: Stretches that a task adds up at a time before it sends them on.
COMBINED = 50_000
INTERNAL = ("_text", "_runs", "_id")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def anchors(words: list[bytes], hashes: _Hashes, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of the anchor, first window) of each run of windows that have the same anchor.

    The anchor of a window is the first of its prefixes of `prefix` words whose hash is least. Equal windows have equal
    anchors at equal places, so a repeated window is found among the suffixes that have its anchor in common.
    """
    n = len(words)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    codes = np.zeros(n - prefix + 1, np.uint64)
    for k in range(prefix):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + h[k : n - prefix + 1 + k]
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(29)

    def least(a, b):
        return np.where(codes[a] <= codes[b], a, b)

    span, best = 1, np.arange(len(codes))
    while 2 * span <= window - prefix + 1:
        best = least(best[:-span], best[span:])
        span *= 2
    more = window - prefix + 1 - span
    best = least(best[: len(best) - more], best[more:]) if more else best
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return codes[best[first]], first


def _find_anchors(window: int, prefix: int):
    """Rows (id, codes, runs, sizes): a run is its first window, and in the lowest byte how many windows it has; its size is in bytes of suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids, codes, runs, sizes = [], [], [], []
            for own, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                words = text.encode().split()
                if len(words) >= window:
                    code, first = anchors(words, hashes, window, prefix)
                    ids.append(own)
                    codes.append(code.view(np.int64))
                    many = np.diff(first, append=len(words) - window + 1)
                    runs.append(first * 256 + many)
                    ends = np.cumsum([0, *map(len, words)])
                    sizes.append(many * (ends[first + many + window - 1] - ends[first] + many + window + OVERHEAD))
            if ids:
                offsets = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (codes, runs, sizes)]], ["id", "codes", "runs", "sizes"])

    return run


def _stretches(text: str, runs: list[dict], window: int) -> Iterator[tuple[int, int, bytes]]:
    """(code, first word, words) of each run of windows."""
    words = text.encode().split()
    for r in runs:
        start, count = r["run"] >> 8, r["run"] & 255
        if start + count + window - 1 <= len(words):
            yield r["code"], start, b" ".join(words[start : start + count + window - 1])


def _count_stretches(window: int):
    """Rows (code, stretch, digest, n). A task adds up equal stretches before they are shuffled, COMBINED of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], int] = {}

        def drained():
            codes, stretches = zip(*found)
            digests = [xxhash.xxh3_128_digest(x) for x in stretches]
            batch = pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(stretches, pa.binary()), pa.array(digests, pa.binary()), pa.array(list(found.values()), pa.int64())], ["code", "stretch", "digest", "n"])
            found.clear()
            return batch

        for batch in batches:
            for text, runs in zip(batch.column("_text").to_pylist(), batch.column("runs").to_pylist()):
                for code, _, stretch in _stretches(text, runs, window):
                    found[code, stretch] = found.get((code, stretch), 0) + 1
                    if len(found) >= COMBINED:
                        yield drained()
        if found:
            yield drained()

    return run


def _place_stretches(window: int):
    """Rows (_id, key, code, digest, start) of the same stretches; key tells texts apart whose ids are equal by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (own, xxhash.xxh3_128_digest(text), code, xxhash.xxh3_128_digest(stretch), first)
                for own, text, runs in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), batch.column("runs").to_pylist())
                for code, first, stretch in _stretches(text, runs, window)
            ]
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_id", "key", "code", "digest", "start"])

    return run


def _word_starts(stretch: bytes) -> list[int]:
    """Where each word begins, and the end."""
    return [0, *(np.flatnonzero(np.frombuffer(stretch, np.uint8) == 32) + 1).tolist(), len(stretch) + 1]


def _words_in_common(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size))
    return a.count(b" ", 0, int(differ[0]) if len(differ) else size)


def maximal_repeats(stretches: list[bytes], window: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(words, its places as (stretch, word)) of each repeat of at least `window` words that no word before or behind extends at all its places.

    The suffixes of all stretches, sorted, are the leaves of the group's suffix tree from left to right. Neighbours' common
    words give the internal nodes, whose depth is the length of a repeat; a node whose leaves follow different words, or begin
    a stretch, can't be extended to the left, as none can to the right.
    """
    texts, starts = [x + b" " for x in stretches], [_word_starts(x) for x in stretches]
    suffixes = sorted((text[i:], at, k) for at, text in enumerate(texts) for k, i in enumerate(starts[at][:-window]))

    def diverse(leaves) -> bool:
        before = {None if k == 0 else texts[at][starts[at][k - 1] : starts[at][k]] for _, at, k in leaves}
        return None in before or len(before) > 1

    path: list[tuple[int, int]] = []  # (depth, first leaf) of the nodes that are open
    for i in range(1, len(suffixes) + 1):
        depth, left = 0, i - 1
        if i < len(suffixes):
            (a, at, k), b = suffixes[i - 1], suffixes[i][0]
            j = starts[at][k + window] - starts[at][k]
            if a[:j] == b[:j]:
                depth = _words_in_common(a, b)
        while path and path[-1][0] > depth:
            deep, left = path.pop()
            if diverse(suffixes[left:i]):
                yield deep, [(at, k) for _, at, k in suffixes[left:i]]
        if depth and (not path or path[-1][0] < depth):
            path.append((depth, left))


def repeated_ranges(stretches: list[tuple[bytes, int]], window: int) -> list[list[int]]:
    """For each stretch (words, how often), the ranges [from, to, from, to, ...] of its words that windows starting elsewhere too cover.

    A stretch that occurs more than once is a repeat as a whole; in the others, repeats are those of the group's suffix tree.
    """
    covered = [[(0, x.count(b" ") + 1)] if n > 1 else [] for x, n in stretches]
    if not all(covered):
        for depth, places in maximal_repeats([x for x, _ in stretches], window):
            for at, k in places:
                if stretches[at][1] == 1:
                    covered[at].append((k, k + depth))
    out = []
    for found in covered:
        ranges: list[int] = []
        for a, b in sorted(found):
            if ranges and a <= ranges[-1]:
                ranges[-1] = max(ranges[-1], b)
            else:
                ranges += [a, b]
        out.append(ranges)
    return out


def _grow_trees(window: int):
    """Rows (code, digest, ranges) of pieces sorted by grp. One group is held at a time, and only the ranges leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, owners = None, {}, {}
        out: tuple[list, list, list] = ([], [], [])

        def flush():
            if sum(held.values()) > 1:
                for (piece, _), ranges in zip(held.items(), repeated_ranges(list(held.items()), window)):
                    for code, digest, at in owners[piece] if ranges else ():
                        for column, value in zip(out, (code, digest, [at + x for x in ranges] if at else ranges)):
                            column.append(value)
            held.clear()
            owners.clear()

        def drained():
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int32()))], ["code", "digest", "ranges"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for own, code, digest, at, piece, n in zip(*(batch.column(c).to_pylist() for c in ("grp", "code", "digest", "at", "piece", "n"))):
                if own != grp:
                    flush()
                    grp = own
                held[piece] = held.get(piece, 0) + n
                owners.setdefault(piece, set()).add((code, digest, at))
            if out[0]:
                yield drained()
        flush()
        if out[0]:
            yield drained()

    return run


def _lengthen(window: int, depth: int):
    """Pieces cut into single windows, dealt out by their first `depth` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for code, digest, at, piece, n in zip(*(batch.column(c).to_pylist() for c in ("code", "digest", "at", "piece", "n"))):
                starts = _word_starts(piece)
                for k, i in enumerate(starts[:-window]):
                    grp = xxhash.xxh64_intdigest(piece[i : starts[k + depth] - 1], depth) - 2**63
                    rows.append((grp, code, digest, at + k, piece[i : starts[k + window] - 1], n))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["grp", "code", "digest", "at", "piece", "n"])

    return run


STRETCHES = "code long, stretch binary, digest binary, n long"
PIECES = "grp long, code long, digest binary, at int, piece binary, n long"
TREES = "code long, digest binary, ranges array<int>"


def depths(window: int, prefix: int) -> list[int]:
    """Lengths of the prefixes that suffixes are dealt out by, one after another, up to the whole window."""
    found = [prefix]
    while found[-1] < window:
        found.append(found[-1] + -(-(window - found[-1]) // 3))
    return found


def _trees(pieces: DataFrame, window: int) -> DataFrame:
    return pieces.repartition("grp").sortWithinPartitions("grp").mapInArrow(_grow_trees(window), TREES)


def split_groups(pieces: DataFrame, window: int, prefix: int) -> DataFrame:
    """Ranges (code, digest, ranges) of pieces of groups that may be large, whose prefixes are lengthened until each fits GROUP_BYTES.

    Pieces are distinct, so copies add nothing. A group whose prefix is the whole window holds one window however often it occurs: it is counted.
    """
    out = []
    size = (F.octet_length("piece") + OVERHEAD) * (F.size(F.split(F.col("piece").cast("string"), " ")) - window + 1)
    for depth in depths(window, prefix)[1:]:
        large = checkpointed(pieces.groupBy("grp").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > GROUP_BYTES).select("grp"))
        if large.isEmpty():
            return _union([*out, _trees(pieces, window)])
        out.append(_trees(pieces.join(large, "grp", "left_anti"), window))
        pieces = checkpointed(pieces.join(large, "grp", "left_semi").select("grp", "code", "digest", "at", "piece", "n").mapInArrow(_lengthen(window, depth), PIECES))
    often = pieces.groupBy("grp", "piece").agg(F.sum("n").alias("often")).where("often > 1")
    whole = pieces.join(often, ["grp", "piece"]).select("code", "digest", F.array("at", F.col("at") + window).alias("ranges"))
    return _union([*out, whole])


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _cut_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_words, n_removed = [], [], []
        for text, runs in zip(batch.column("_text").to_pylist(), batch.column("_runs").to_pylist()):
            words = text.encode().split()
            gone = np.zeros(len(words), bool)
            key = xxhash.xxh3_128_digest(text) if runs else None
            for r in runs or ():
                if r["key"] == key:
                    for a, b in zip(r["ranges"][::2], r["ranges"][1::2]):
                        gone[r["start"] + a : r["start"] + b] = True
            left = [w for w, x in zip(words, gone.tolist()) if not x] if gone.any() else words
            kept.append(b" ".join(left).decode())
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
        names = [f.name for f in batch.schema if f.name not in INTERNAL]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """All rows of docs, with text cut, n_words (before) and n_removed; its other columns are kept, those of these names replaced.

    Words (runs of anything but ASCII blanks) that a window of `window` words covers are removed if the window's words also start
    elsewhere in any document; the rest is joined by single blanks. Null counts as empty, and becomes empty.

    1. Anchors: each run of windows has a prefix of `prefix` words in common. Only suffixes whose prefix starts more than
       once can be repeated; the others are left out here.
    2. The suffixes that remain are dealt out by that prefix, and by longer ones where the group would not fit GROUP_BYTES. Equal
       stretches of words are counted before they are dealt out, so that copies add nothing to a group.
    3. Each group's suffix tree gives the maximal repeats; they return to the places that their stretches came from.
    """
    prefix = max(prefix, window - 254)
    docs = docs.drop("n_words", "n_removed", *INTERNAL)
    keyed = docs.withColumn("_text", F.coalesce("text", F.lit(""))).drop("text").withColumn("_id", F.xxhash64("_text"))
    found = checkpointed(keyed.select("_id", "_text").mapInArrow(_find_anchors(window, prefix), "id long, codes array<long>, runs array<long>, sizes array<long>"))
    counts = found.select(F.explode(F.arrays_zip("codes", "sizes")).alias("r")).groupBy(F.col("r.codes").alias("code")).agg(F.count("*").alias("n"), F.sum("r.sizes").alias("size")).where("n > 1")
    # A code that starts in more than 1 of HOT_SHARE places is hot; there are fewer than HOT_SHARE of them, which bounds what is broadcast.
    hot_from = max(2, (found.agg(F.sum(F.size("codes"))).first()[0] or 0) // HOT_SHARE)
    counts = counts.select("code", (F.col("size") > GROUP_BYTES).alias("long"), (F.col("n") > hot_from).alias("hot"))
    flagged = checkpointed(counts.where("hot or long"))
    hot = F.broadcast(flagged.where("hot").select("code", "long"))
    each = found.select("id", F.explode(F.arrays_zip("codes", "runs")).alias("r")).select("id", F.col("r.codes").alias("code"), F.col("r.runs").alias("run"))
    cold = each.join(hot, "code", "left_anti").join(counts.where("not hot").select("code", "long"), "code")
    live = each.join(hot, "code").select(*cold.columns).unionByName(cold).groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("code", "run", "long")).alias("runs"))
    texts = keyed.join(live, "_id")  # with all columns, so that the shuffle of keyed serves the last join too
    split = not flagged.where("long").isEmpty()
    counted = (texts.withColumn("runs", F.expr("filter(runs, r -> not r.long)")) if split else texts).mapInArrow(_count_stretches(window), STRETCHES)
    small = counted.repartition("code").select(F.col("code").alias("grp"), "code", "digest", F.lit(0).alias("at"), F.col("stretch").alias("piece"), "n")
    trees = small.sortWithinPartitions("grp").mapInArrow(_grow_trees(window), TREES)
    if split:  # codes that may be too large for a group, with copies counted; so that only these need their distinct stretches first
        many = texts.select("_text", F.expr("filter(runs, r -> r.long)").alias("runs")).where("size(runs) > 0").mapInArrow(_count_stretches(window), STRETCHES)
        many = checkpointed(many.groupBy("code", "digest").agg(F.first("stretch").alias("piece"), F.sum("n").alias("n")))
        trees = trees.unionByName(split_groups(many.select(F.col("code").alias("grp"), "code", "digest", F.lit(0).alias("at"), "piece", "n"), window, prefix))
    places = texts.mapInArrow(_place_stretches(window), "_id long, key binary, code long, digest binary, start int")
    covers = places.join(trees, ["code", "digest"]).groupBy("_id").agg(F.collect_set(F.struct("key", "start", "ranges")).alias("_runs"))
    joined = keyed.join(covers, "_id", "left")
    others = [f for f in joined.schema.fields if f.name not in INTERNAL]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["text string, n_words long, n_removed long"])
    return joined.mapInArrow(_cut_repeats, schema)
