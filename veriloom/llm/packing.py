"""Packing documents into sequences: shortest-pack-first over the histogram of piece lengths, joined back to the pieces by rank."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Ids in a sequence; the id that ends a document; the id that fills a sequence up.
SEQUENCE, END, FILL = 4096, 2, 2
#: Chunks of a text whose ids a worker remembers (twice that at most), and the longest that it does; characters that are encoded at a time.
REMEMBERED, LONGEST, WINDOW = 400_000, 48, 1 << 20
#: Pieces of one length are numbered in that many tasks or more; rows of a returned batch.
CHUNKS, ROWS = 256, 8192

#: Marks between a Latin letter or digit and a blank are a token or more of their own, so that cutting there changes no ids.
#: (Not after U+0130, which ends in a combining dot in lower case; not <|>, which belong to special tokens.)
_MARK = re.compile(r"([.,;:!?*%$#&](?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f].)[.,;:!?*%$#&]*)(?=[ \n\t\r]|$)")


class ChunkIds:
    """Ids (little-endian, 32 bits) of texts, put together from those of their chunks: stretches without blanks.

    The tokenizer's tokens never reach over a blank, and all its steps look at one such stretch at a time. Chunks are remembered in two
    generations; the older one is dropped when the newer one is full, so what occurs again and again stays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain, self.bytewise = (Tokenizer.from_file(path) for _ in range(3))
        blanks = pre_tokenizers.Split(" ", "removed")  # enough for words in lower case, and quicker
        self.plain.normalizer, self.plain.pre_tokenizer = None, blanks
        self.bytewise.normalizer, self.bytewise.pre_tokenizer = None, pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> ChunkIds:
        """The one of this Python worker. It hangs on the tokenizers module, which a worker imports once, while this module travels with each task."""
        import tokenizers

        kept = vars(tokenizers).setdefault("_chunk_ids", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Words are encoded together and told apart by the tokens that end one; what isn't one word, or doesn't come out as one, is encoded alone."""
        words = [c for c in chunks if c.isalpha()]
        ascii_words = [w for w in words if w.isascii()]
        self._together(ascii_words, self.plain, " ".join(ascii_words).lower())
        lowered = {w: unicodedata.normalize("NFC", w).lower() for w in words if not w.isascii() and "\u03a3" not in w}  # lower() looks around a capital sigma
        others = [w for w, low in lowered.items() if low.isalpha()]
        self._together(others, self.bytewise, " ".join(lowered[w] for w in others))
        self.new.update((c, self._one(c)) for c in chunks if c not in self.new)

    def _together(self, words: list[str], tokenizer, text: str) -> None:
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if words and len(ends) == len(words) and ends[-1] == len(ids):
            raw = ids.tobytes()
            self.new.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(words, [0, *ends[:-1].tolist()], ends.tolist()))

    def together(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Chunks that are new are learnt for all of them at once."""
        apart = [_MARK.sub(r" \1", text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in texts]
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        unknown = set().union(*apart).difference(self.new)
        if again := {c for c in unknown if c in self.old}:
            self.new.update((c, self.old[c]) for c in again)
        if unknown := sorted(unknown - again):
            self._learn(unknown)
        ids = [b"".join(map(self.new.__getitem__, chunks)) for chunks in apart]
        for c in unknown:
            if len(c) > LONGEST:
                del self.new[c]
        return ids

    def windows(self, text: str) -> Iterator[bytes]:
        """Ids of a text, some WINDOW characters at a time."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + WINDOW) if len(text) - at > WINDOW else -1
            end = len(text) if end < 0 else end
            yield self.together([text[at:end]])[0]
            at = end

    def each(self, rows: list[tuple[object, str]]) -> Iterator[tuple[object, Iterator[bytes]]]:
        """(id, ids in parts) of rows (id, text): texts are taken together up to WINDOW characters, longer ones alone and in windows."""
        held, size = [], 0
        for own, text in rows:
            if len(text) > WINDOW:
                yield own, self.windows(text)
                continue
            held.append((own, text))
            size += len(text)
            if size >= WINDOW:
                yield from zip([own for own, _ in held], map(lambda x: iter([x]), self.together([text for _, text in held])))
                held, size = [], 0
        yield from zip([own for own, _ in held], map(lambda x: iter([x]), self.together([text for _, text in held])))


def cut(windows: Iterator[bytes], size: int, keep: bool) -> tuple[list[tuple[int, int, int, bytes | None]], int]:
    """Pieces (start, length, CRC-32, ids if kept) of `size` ids, the last one shorter, and the number of all ids; END is added."""
    pieces, held, start, step = [], bytearray(), 0, 4 * size

    def off(n: int):
        nonlocal start
        ids = bytes(held[:n])
        del held[:n]
        pieces.append((start, n // 4, zlib.crc32(ids), ids if keep else None))
        start += n // 4

    for ids in windows:
        held += ids
        while len(held) >= step:
            off(step)
    held += np.array([END], "<u4").tobytes()
    off(len(held))
    return pieces, start


def _tokenize(path: str, size: int, keep: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ChunkIds.of_worker(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep
        kinds = [id_type, *[pa.int64()] * 4, pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for found in batches:
            rows: list[tuple] = []
            for own, parts in ids_of.each([(own, text or "") for own, text in zip(found.column("doc_id").to_pylist(), found.column("text").to_pylist())]):
                pieces, total = cut(parts, size, keep)
                rows += [(own, start, length, crc, total, ids)[: len(names)] for start, length, crc, ids in pieces]
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return run


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids) of the pieces of each document's ids.

    A document is the ids of its text (null: empty) and END. It is cut at every `size` ids, so pieces but the last are full; the last one is not empty.
    Every row counts, repeated ones too; an id may be null and of any type.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_tokenize(path, size, keep_ids, to_arrow_type(kind)), schema)


def shortest_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, how many sequences) for a histogram of lengths.

    Lengths are placed longest first, each in the packs that hold least; a new pack is begun where it doesn't fit in any. Packs with equal
    contents are kept as one pattern with a count, so the work grows with the number of different lengths, not with that of pieces.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = {}  # by what is used: patterns and their counts
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        while left:
            used = min(open_packs, default=size)
            if used + length > size:
                each = size // length  # a pack that is begun holds least until no more of this length fits
                for n, count in ((each, left // each), (left % each, min(left % each, 1))):
                    if count:
                        open_packs.setdefault(n * length, {})[(length,) * n] = count
                break
            pattern, count = open_packs[used].popitem()
            took = min(count, left)
            if count > took:
                open_packs[used][pattern] = count - took
            if not open_packs[used]:
                del open_packs[used]
            packs = open_packs.setdefault(used + length, {})
            packs[(*pattern, length)] = packs.get((*pattern, length), 0) + took
            left -= took
    return [x for used in sorted(open_packs) for x in sorted(open_packs[used].items())]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Where the pieces of a length go, by rank: arrays (length, first rank, first sequence, offset), sorted by length and rank.

    The pieces of a length that a pattern asks for are consecutive ranks; the i-th of them goes to the i-th sequence of the pattern.
    """
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, offset))
            ranks[length] = rank + count
            offset += length
        sequence += count
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def _place(plan: tuple[np.ndarray, ...]):
    lengths, ranks, sequences, offsets = plan
    keys = lengths * 2**48 + ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * 2**48 + rank, "right") - 1
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    return run


def place(cut_up: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """cut_up (rows of pieces()) with sequence_id and offset.

    Only the histogram, of `size` rows at most, reaches the driver. Pieces of a length are ranked in chunks by hash, so that a length that
    a third of all pieces share is spread over tasks; a chunk's ranks begin after those of the chunks before it.
    """
    cut_up = checkpointed(cut_up)
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    chunks = max(CHUNKS, sum(histogram.values()) // 50_000)
    chunked = cut_up.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(chunks)))
    counts = chunked.groupBy("length", "_chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = chunked.withColumn("_within", within).join(counts.select("length", "_chunk", before.alias("_before")), ["length", "_chunk"])
    ranked = ranked.select(*cut_up.columns, (F.col("_before") + F.col("_within")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema.fields)
    return ranked.mapInArrow(_place(places(shortest_first(histogram, size))), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. An empty table gives no rows."""
    return place(pieces(docs, path, size), size)


def sequences(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: (sequence_id, used, lengths of the pieces in order, ids).

    ids holds little-endian 32-bit ids, filled up with FILL to `size`; a sequence whose ids are a power of two in number stays as long as it is.
    A sequence has `size` pieces at most, which bounds the groups.
    """
    placed = place(pieces(docs, path, size, keep_ids=True), size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    fill = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, F.lit(0)).otherwise(F.lit(size) - F.col("used")).cast("int")
    filling = F.lit(np.full(size, FILL, "<u4").tobytes())
    return joined.select("sequence_id", "used", F.transform("parts", lambda p: p["length"]).alias("lengths"), F.concat(ids, F.substring(filling, F.lit(1), 4 * fill)).alias("ids"))
