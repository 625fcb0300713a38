"""Phrase collocations: merged count-min sketches tell which phrases may be frequent, a second pass counts those exactly, then they are scored and subsumed."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Least count, words of the longest phrase, phrases a language, share (of 100) of a phrase's count at which a longer one stands for it, unit of scores.
LEAST, LONGEST, BEST, COVERED, UNIT = 30, 4, 2000, 80, 2_000_000
#: Rows of a sketch; bits of the number of cells in a row; bits of a slice, which is merged by itself. A task holds DEPTH * 2 ** BITS bytes (32 MB).
DEPTH, BITS, SLICE = 2, 24, 18
#: Words that a task takes in a round; distinct words it remembers; bytes of a text that are split at a time.
ROUND, REMEMBERED, WINDOW = 600_000, 200_000, 1 << 22
#: Groups in which candidates are ranked at first, in rows.
RANKED = 20_000

#: A to Z go to a to z, tabs to blanks, and what ends a piece to a full stop, which so stands for a boundary only.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers of the words of one language in a task, from 1; words hashed with the language, so that languages share sketches but no counts."""

    def __init__(self, owner: _Text, lang: str):
        super().__init__({b".": 0})
        self.owner, self.lang, self.seed = owner, lang, xxhash.xxh32_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        self.owner.words.append(word)
        self.owner.langs.append(self.lang)
        self.owner.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        found = self[word] = len(self.owner.words) - 1
        return found


class _Text:
    """Word numbers of a task's texts in rounds. words, langs and hashes belong to the numbers; number 0 is a boundary."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.words, self.langs, self.hashes = [b"."], [""], array("Q", [0])
        self.of: dict[str, _Words] = {}

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        known = self.of.get(lang) or self.of.setdefault(lang, _Words(self, lang))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def rounds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Arrays of numbers. Phrases begin at all places but the last LONGEST - 1, which begin the next array too, so each occurrence of a phrase is met once."""
        keep = LONGEST - 1
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                for words in _split(text or b""):
                    held.append(self.numbers(lang, words))
                    size += len(words)
                    if size >= ROUND:
                        yield (whole := np.concatenate(held))
                        rest = whole[-keep:]
                        if len(self.words) > REMEMBERED:
                            old = [(self.langs[i], self.words[i]) for i in rest.tolist()]
                            self.forget()
                            rest = np.concatenate([self.numbers(of, [word]) for of, word in old])
                        held, size = [rest], 0
                held.append(np.zeros(keep, np.int64))
        if held:
            yield np.concatenate(held)


def _split(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        end = at + WINDOW
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r.,;:!?":
            end += 1
        yield text[at:end].translate(_BYTES).replace(b".", b" . ").split()
        at = end


def _cells(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The cell of each code in each row of a sketch."""
    for row in range(DEPTH):
        yield ((codes >> np.uint64(32 * row)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _longer(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Codes of phrases from those of their first words and their last word."""
    x = (code ^ (code >> np.uint64(29))) * _MIX + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sketch:
    """What is left of a merged sketch: a bit for each cell that reached `least`. A phrase may be frequent only if its bits are set in all rows."""

    def __init__(self, bits: int, slices: list[tuple[int, int, bytes]]):
        self.bits, self.slices, self.rows = bits, slices, None

    def may_be_frequent(self, codes: np.ndarray) -> np.ndarray:
        if self.rows is None:
            step = min(1 << self.bits, 1 << SLICE) // 8
            self.rows = np.zeros((DEPTH, (1 << self.bits) // 8), np.uint8)
            for row, part, packed in self.slices:
                self.rows[row, part * step : (part + 1) * step] = np.frombuffer(zstandard.decompress(packed), np.uint8)
        found = np.ones(len(codes), bool)
        for bits, cells in zip(self.rows, _cells(codes, self.bits)):
            found &= (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
        return found

    def __getstate__(self):
        return self.bits, self.slices, None

    def __setstate__(self, state):
        self.bits, self.slices, self.rows = state


def _add(counts: np.ndarray, cells: np.ndarray) -> None:
    """Counts cells; counts stop at 255, above any `least` that is allowed."""
    cells.sort()
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    more = np.minimum(np.diff(first, append=len(cells)), 255).astype(np.uint16)
    counts[cells[first]] = np.minimum(counts[cells[first]] + more, 255)


def _slices(counts: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, slice, counts) of the slices of a sketch that aren't empty."""
    span = 1 << min(bits, SLICE)
    for row, cells in enumerate(counts):
        for part in range((1 << bits) // span):
            own = cells[part * span : (part + 1) * span]
            if own.any():
                yield row, part, zstandard.compress(own.tobytes(), 1)


def _sketch(bits: int, words: Sketch | None):
    """Rows (row, slice, counts) of a task's sketch: of words if `words` is None, else of the phrases whose words may all be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, counts = _Text(), np.zeros((DEPTH, 1 << bits), np.uint8)
        for x in text.rounds(batches):
            hashes = np.array(text.hashes, np.uint64)
            starts = len(x) - LONGEST + 1
            if words is None:
                found = [hashes[x[:starts][x[:starts] > 0]]]
            else:
                found = [code[ok] for _, code, ok in _phrases(x, hashes, words.may_be_frequent(hashes), None)]
            for codes in found:
                if len(codes):
                    for own, cells in zip(counts, _cells(codes, bits)):
                        _add(own, cells)
        for row, part, packed in _slices(counts, bits):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], ["row", "slice", "counts"])

    return run


def _phrases(x: np.ndarray, hashes: np.ndarray, frequent: np.ndarray, sketch: Sketch | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 2 to LONGEST words: (words, code at each start, whether a phrase that may be frequent begins there).

    All parts of a frequent phrase are frequent, so a longer one is looked up only where both of its shorter ones may be.
    """
    starts = len(x) - LONGEST + 1
    ok = frequent[x] & (x > 0)
    code = hashes[x]
    for n in range(2, LONGEST + 1):
        m = len(x) - n + 1
        ok = ok[:m] & ok[1 : m + 1]
        code = _longer(code[:m], hashes[x[n - 1 :]])
        if sketch is not None:
            at = np.flatnonzero(ok)
            ok[at] = sketch.may_be_frequent(code[at])
        yield n, code[:starts], ok[:starts]


def _merge(least: int):
    """Rows (row, slice, bits) from rows sorted by row and slice: counts are added up, stopping at 255, one slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def bits() -> pa.RecordBatch:
            packed = zstandard.compress(np.packbits(total >= least, bitorder="little").tobytes(), 3)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([packed], pa.binary())], ["row", "slice", "bits"])

        for batch in batches:
            for row, part, counts in zip(*(batch.column(c).to_pylist() for c in ("row", "slice", "counts"))):
                if (row, part) != key:
                    if key is not None:
                        yield bits()
                    key, total = (row, part), 0
                total = np.minimum(np.frombuffer(zstandard.decompress(counts), np.uint8).astype(np.uint16) + total, 255)
        if key is not None:
            yield bits()

    return run


def sketched(texts: DataFrame, least: int, bits: int, words: Sketch | None = None) -> Sketch:
    """The merged sketch of all words, or of all phrases of words that may be frequent. What reaches the driver is at most DEPTH * 2 ** bits bits (4 MB)."""
    counts = texts.mapInArrow(_sketch(bits, words), "row int, slice int, counts binary")
    merged = counts.repartition("row", "slice").sortWithinPartitions("row", "slice").mapInArrow(_merge(least), "row int, slice int, bits binary")
    return Sketch(bits, sorted((r["row"], r["slice"], bytes(r["bits"])) for r in merged.collect()))


def _exact(words: Sketch, sketch: Sketch):
    """Rows (lang, n, phrase, f): counts of the survivors in each round of a task. Phrases are numbered by (number of the first words, last word), so equal numbers mean equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _Text()

        def batch(langs: list[str], n: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.full(len(langs), n, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "n", "phrase", "f"])

        for x in text.rounds(batches):
            hashes, known, langs = np.array(text.hashes, np.uint64), text.words, text.langs
            frequent = words.may_be_frequent(hashes)
            frequent[0] = False
            starts = len(x) - LONGEST + 1
            counts = np.bincount(x[:starts], minlength=len(known))
            at = np.flatnonzero((counts > 0) & frequent).tolist()
            yield batch([langs[i] for i in at], 1, [known[i] for i in at], counts[at])
            number, names, first = x, known, np.arange(len(known))
            for n, _, ok in _phrases(x, hashes, frequent, sketch):
                at = np.flatnonzero(ok)
                keys, place, inverse, counts = np.unique(number[at] << 32 | x[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                names = [names[a] + b" " + known[b] for a, b in zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist())]
                first = x[at[place]]
                yield batch([langs[i] for i in first.tolist()], n, names, counts)
                number = np.zeros(starts, np.int64)
                number[at] = inverse

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n, f) of all phrases of 1 to LONGEST words with f >= least, (lang, total) with the number of all words).

    Three passes over the texts. The first sketches words, the second phrases of words that may be frequent, the third counts exactly what both sketches let
    through. Sketches only ever overestimate, so nothing frequent is lost, and what passed by chance goes when its exact count is below `least`.
    A sketch has 2 ** bits cells a row at every size of the table: the more phrases share a cell, the more the third pass counts, never other rows.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be between 1 and 255")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.regexp_replace(F.col("text"), r"[.,;:!?\x0A-\x0D]", " ")
    totals = checkpointed(texts.groupBy("lang").agg(F.sum(F.regexp_count(text, F.lit(r"[^\x20\x09]+"))).cast("long").alias("total")))
    words = sketched(texts, least, bits)
    phrases = sketched(texts, least, bits, words)
    counted = texts.mapInArrow(_exact(words, phrases), "lang string, n int, phrase string, f long")
    return checkpointed(counted.groupBy("lang", "phrase").agg(F.first("n").alias("n"), F.sum("f").alias("f")).where(F.col("f") >= least)), totals


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, n, a, l, r, score): of all cuts in two the one that scores least, of equal ones the first.

    score = floor(UNIT * a / (l + r)), in decimals, as the product may pass 64 bits. Parts of a frequent phrase are frequent, so both are in counts.
    """
    words = F.split("phrase", " ")
    cuts = counts.where("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"), words.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "phrase", "n", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("right"))
    part = [counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)) for side, f in (("left", "l"), ("right", "r"))]
    cuts = cuts.join(part[0], ["lang", "left"]).join(part[1], ["lang", "right"])
    score = F.expr(f"CAST(CAST(a AS DECIMAL(19,0)) * {UNIT} DIV (CAST(l AS DECIMAL(19,0)) + r) AS LONG)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "phrase", "n", "a").agg(best).select("lang", "phrase", "n", "a", "b.l", "b.r", "b.score")


def subsumed(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase) of the candidates that some longer candidate holds, its words in a row, `covered` of 100 times or more."""
    words = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = counts.where("n > 2").select("lang", "n", F.col("f").alias("longer"), words.alias("w")).select("lang", "longer", F.explode(F.array_distinct(inner)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return counts.join(most, ["lang", "phrase"]).where(F.col("longer").cast("decimal(19,0)") * 100 >= F.col("f").cast("decimal(19,0)") * covered).select("lang", "phrase")


def first_of_each(found: DataFrame, best: int) -> DataFrame:
    """The first `best` rows of each language with their rank, by score and a, falling, and phrase.

    Rows are first ranked in groups of some RANKED by hash, of which each keeps `best` at most; groups are joined, ten at a time, until a language is one.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    groups = found.count() // max(RANKED, 10 * best)
    while groups > 1:
        kept = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order))
        found = found.withColumn("rank", kept).where(F.col("rank") <= best).drop("rank")
        groups //= 10
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, covered: int = COVERED, bits: int = BITS) -> DataFrame:
    """The `best` collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    A to Z are lower-cased; texts (null: empty) are split into pieces at .,;:!? and line ends, and pieces into words at blanks and tabs. Phrases are 2 to LONGEST
    words of one piece with a = count >= least. Rows count as often as they occur; a null language is `und`; an empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, least, bits)
    found = scored(counts).join(subsumed(counts, covered), ["lang", "phrase"], "left_anti")
    ranked = first_of_each(checkpointed(found), best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
