"""Benchmark decontamination: seeds of rare word pairs join documents to test items, Smith-Waterman alignment scores what they find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import checkpointed, joinable

#: Alignment: a match, a mismatch, a gap; the share of an item's full score from which a document counts as contaminated.
MATCH, MISMATCH, GAP = 2, 1, 1
CONTAMINATED = 0.5
#: Bits of a filter for each code in it, and the most bits of a filter (16 MB). A full filter lets more rows through to the join; no result depends on it.
FILTER_BITS, MOST_BITS = 64, 1 << 27
#: Words whose hashes a task remembers.
REMEMBERED = 500_000

#: Lower case, and ASCII punctuation to blanks.
_BLANKS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BLANKS).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def hashes_of(text: str | None, held: _Hashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    code = ((first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(29))


def seeds_at(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places) of all pairs of a word and the next or the next but one, and of all single words."""
    codes = [pair_codes(h[:-gap], h[gap:]) for gap in (1, 2) if len(h) > gap] + [h]
    return np.concatenate(codes), np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])


def needed(n: int, least: float) -> tuple[int, int]:
    """(places of an item of n words that are seeds, how many of them any alignment of `least` hits); (n, 0) if single words are needed.

    Of an alignment with m matches and penalties p, 2m - p >= 2 * least * n. Two matches that follow each other with at most one word
    between them on either side are close; others cost 2 at least, so m - 1 - p / 2 >= least * n - 1 matches are followed closely. An item
    has n - 1 places of a first word; if all but some are left out, that many fewer are hit.
    """
    close = int(np.ceil(least * n - 1e-9)) - 1
    if close < 1:
        return n, 0
    hit = max(1, close // 2)
    return n - 1 - close + hit, hit


def span(n, least: float):
    """Words of a document that an alignment of `least` reaches over at most: m + p <= 3m - 2 * least * n."""
    return np.ceil((3 - 2 * least) * n).astype(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over word numbers: (best local score, index in the passage at which it ends)."""
    drift = np.arange(len(passage) + 1) * GAP
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above - GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, MATCH, -MISMATCH))
        row = np.maximum.accumulate(row + drift) - drift  # a gap may end at any earlier column
        if (high := int(row.max())) > best:
            best, end = high, int(row.argmax())
        above = row
    return best, end


def filter_of(codes: DataFrame) -> tuple[int, bytes]:
    """(bits, bitmap) of the column code: where code mod bits is set, the code may be in it."""
    bits = min(MOST_BITS, 1 << max(16, (codes.count() * FILTER_BITS).bit_length()))
    width = 1 << 16

    def chunk(rows: pa.Table) -> pa.Table:
        held = np.zeros(width, bool)
        held[rows["slot"].to_numpy() % width] = True
        return pa.table({"part": rows["part"].slice(0, 1), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    slot = F.pmod("code", F.lit(bits))
    parts = codes.select(slot.alias("slot")).distinct().withColumn("part", F.floor(F.col("slot") / width)).groupBy("part").applyInArrow(chunk, "part long, held binary")
    held = bytearray(bits // 8)
    for r in parts.collect():  # MOST_BITS at most
        held[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = r["held"]
    return bits, bytes(held)


def _may_hold(codes: np.ndarray, bits: int, held: np.ndarray) -> np.ndarray:
    slot = codes & np.uint64(bits - 1)
    return (held[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _item_places(least: float):
    """Rows (_item, n, hit, keep, at, code, a, b) of rows (_item, text): all that can be seeds, of words a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Hashes()
        names = ["_item", "n", "hit", "keep", "at", "code", "a", "b"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for item, text in zip(batch.column("_item").to_pylist(), batch.column("text").to_pylist()):
                h = hashes_of(text, held)
                n = len(h)
                keep, hit = needed(n, least)
                for gap in (1, 2) if hit else (0,):
                    a, b = h[: n - gap], h[gap:]
                    own = (np.full(len(a), item), np.full(len(a), n), np.full(len(a), max(1, hit)), np.full(len(a), keep), np.arange(len(a)), (pair_codes(a, b) if gap else a).view(np.int64), a.view(np.int64), b.view(np.int64))
                    for column, value in zip(rows, own):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in rows], names)

    return run


def _count_words(bits: int, bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.frombuffer(bitmap, np.uint8), _Hashes()
        for batch in batches:
            h = np.concatenate([np.zeros(0, np.uint64), *[hashes_of(t, known) for t in batch.column("text").to_pylist()]])
            word, n = np.unique(h[_may_hold(h, bits, held)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return run


def _hits(bits: int, bitmap: bytes):
    """Rows (_key, code, place) of the codes of rows (_key, text) that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.frombuffer(bitmap, np.uint8), _Hashes()
        for batch in batches:
            keys, found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist()):
                codes, at = seeds_at(hashes_of(text, known))
                some = np.flatnonzero(_may_hold(codes, bits, held))
                if len(some):
                    keys.append(np.full(len(some), key))
                    found.append(codes[some])
                    places.append(at[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places))], ["_key", "code", "place"])

    return run


def seeds_of(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Rows (code, _item, at, n, hit): the rarest places of each item (rows _item, text), as many as are needed so that no alignment of `least` is lost.

    A place is as common as its words make a pair by chance, going by the counts of words in all documents. So a passage that
    leaked into many documents doesn't make its own seeds common.
    """
    places = checkpointed(items.mapInArrow(_item_places(least), "_item long, n long, hit long, keep long, at long, code long, a long, b long"))
    words = places.select(F.col("a").alias("code")).union(places.select("b")).distinct()
    counts = checkpointed(docs.select("text").mapInArrow(_count_words(*filter_of(words)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    first, second = counts.select(F.col("word").alias("a"), F.col("n").alias("_x")), counts.select(F.col("word").alias("b"), F.col("n").alias("_y"))
    weighed = places.join(first, "a", "left").join(second, "b", "left")
    chance = F.log1p(F.coalesce("_x", F.lit(0))) + F.log1p(F.coalesce("_y", F.lit(0)))
    each = weighed.groupBy("_item", "n", "hit", "keep", "at").agg(F.max(chance).alias("chance"), F.collect_set("code").alias("codes"))
    nth = F.row_number().over(Window.partitionBy("_item").orderBy("chance", "at"))
    kept = each.withColumn("nth", nth).where("nth <= keep")
    return checkpointed(kept.select(F.explode("codes").alias("code"), "_item", "at", "n", "hit"))


def _scored(least: float, schema: pa.Schema):
    """Rows (doc_id, item_id, score, first_word, end_word, _own) of rows (doc_id, _own, text, item_id, item, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            some, rows = [], []
            for k, (text, item, windows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "item", "windows")))):
                h, own = hashes_of(text, known), hashes_of(item, known)
                reach, best = int(span(len(own), least)), (0.0, 0, 0)
                for w in windows:
                    a = w * reach
                    score, end = align(own, h[a : a + 2 * reach])
                    best = max(best, (score / (MATCH * len(own)), -max(0, a + end - len(own)), a + end))
                if best[0] >= least:
                    some.append(k)
                    rows.append((best[0], -best[1], best[2]))
            if some:
                chosen = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([chosen.column("doc_id"), chosen.column("item_id"), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:5])], chosen.column("_own")], schema=schema)

    return run


def _found(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    docs = docs.select("doc_id", "text").where("text is not null")
    items = checkpointed(items.select("item_id", "text").where("text is not null").distinct().withColumn("_item", F.xxhash64("item_id", "text")))
    seeds = seeds_of(docs, items.select("_item", "text"), least)
    key = F.xxhash64("doc_id", "text").alias("_key")
    hits = docs.select(key, "text").mapInArrow(_hits(*filter_of(seeds.select("code"))), "_key long, code long, place int")
    reach = F.ceil(F.lit(3 - 2 * least) * F.col("n") - 1e-9)
    near = hits.join(joinable(seeds), "code").withColumn("w", F.floor(F.col("place") / reach))
    # An alignment lies within two neighbouring windows of the words that it can reach over.
    near = near.select("_key", "_item", "at", "hit", F.explode(F.when(F.col("w") > 0, F.array(F.col("w") - 1, "w")).otherwise(F.array("w"))).alias("w")).distinct()
    close = near.groupBy("_key", "_item", "w", "hit").agg(F.count("*").alias("c")).where("c >= hit")
    pairs = checkpointed(close.groupBy("_key", "_item").agg(F.array_sort(F.collect_list("w")).alias("windows")))
    keys = joinable(checkpointed(pairs.select(F.col("_key").alias("_hit")).distinct()))
    texts = docs.join(keys, F.xxhash64("doc_id", "text") == F.col("_hit")).select(F.col("_hit").alias("_key"), "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("_own"), "text")
    both = texts.join(pairs, "_key").join(items.select("_item", "item_id", F.col("text").alias("item")), "_item").select("doc_id", "_own", "text", "item_id", "item", "windows")
    kinds = [docs.schema["doc_id"].dataType, items.schema["item_id"].dataType]
    schema = pa.schema([("doc_id", to_arrow_type(kinds[0])), ("item_id", to_arrow_type(kinds[1])), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("_own", pa.binary())])
    return both.mapInArrow(_scored(least, schema), f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, score double, first_word long, end_word long, _own binary")


def contaminated(docs: DataFrame, items: DataFrame, least: float = CONTAMINATED) -> DataFrame:
    """Rows (doc_id, item_id, score, first_word, end_word) for each document and item that align to `least` of the item's full score, all of them.

    Whole texts are searched; a null text holds nothing; repeated documents give a row each, repeated items count once; items without words
    are never found; an item_id with several texts gives a row for each that is found. Of places that score alike the first one is given.
    Ids may be of any type, null included. Other columns are ignored. Empty tables give no rows.

    Seeds are a table that is joined to the documents' codes; pairs that hit enough seeds in one stretch are aligned. Of the items
    only a filter of bounded size is sent with the tasks (and the seeds, where they are few).
    """
    return _found(docs, items, least).drop("_own")


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = CONTAMINATED) -> DataFrame:
    """The rows in which no item scores `least` or more (see contaminated), with the columns of docs. Rows with a null text stay; repeated rows go or stay together."""
    gone = joinable(checkpointed(_found(docs, items, least).select(F.col("doc_id").alias("_id"), F.col("_own").alias("_gone")).distinct()))
    own = F.unhex(F.md5(F.col("text").cast("binary")))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (own == F.col("_gone")), "left_anti")
